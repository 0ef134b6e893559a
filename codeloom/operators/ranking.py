"""Ranks, caps and cuts that stay spread out when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import fits
from codeloom.sources.tables import saved

FAN = 64
ONE_TASK = 100_000


def first_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Exact first ``n`` rows of each group, with their 1-based rank.

    Each map task keeps at most ``n`` rows per group before the shuffle, and a
    group is merged by up to ``FAN`` tasks first, so a group with most of the
    rows does not land in one task. ``order`` must be total within a group.
    """
    def ranked(frame: DataFrame, keys: list[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)

    fanned = df.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    merged = ranked(fanned, [*groups, "_fan"]).drop(rank, "_fan")
    return ranked(merged, list(groups))


def ratio_split(
    df: DataFrame, id_col: str, train: float = 0.8, validation: float = 0.1, seed: int = 42
) -> DataFrame:
    """Exact shuffle split: ``floor(n*train)``, ``floor(n*validation)``, rest.

    Rows are ordered by a seeded hash of their unique id. Two passes over the
    id column alone find the two boundary keys: a histogram over 65,536 hash
    buckets, then a ranking of the rows in the two buckets the cuts fall in.
    The rows themselves are neither sorted nor shuffled.
    """
    key = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.lit(":"), F.col(id_col).cast("string"))
    keys = df.select(key.alias("_key")).withColumn("_bucket", F.substring("_key", 1, 4))
    # At most 65,536 rows from here on, whatever the size of the input.
    histogram = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_bucket")
    everything = running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    histogram = histogram.select(
        "_bucket",
        F.sum("_n").over(running).alias("_end"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_start"),
        F.sum("_n").over(everything).alias("_total"),
    )
    n_train = F.floor(F.col("_total") * F.lit(train))
    cuts = F.array(
        F.struct(F.lit("train").alias("cut"), n_train.alias("at")),
        F.struct(F.lit("validation").alias("cut"), (n_train + F.floor(F.col("_total") * F.lit(validation))).alias("at")),
    )
    crossing = (
        histogram.select("_bucket", "_start", "_end", F.inline(cuts))
        .filter((F.col("at") > F.col("_start")) & (F.col("at") <= F.col("_end")))
        .select("_bucket", "cut", (F.col("at") - F.col("_start")).alias("_place"))
    )
    # Two rows at most: one bucket per cut.
    near = keys.join(F.broadcast(crossing), "_bucket")
    place = F.row_number().over(Window.partitionBy("cut").orderBy("_key"))
    bounds = near.withColumn("_rank", place).filter(F.col("_rank") == F.col("_place"))
    last = {cut: F.max(F.when(F.col("cut") == cut, F.col("_key"))).alias(cut) for cut in ("train", "validation")}
    pair = bounds.agg(F.struct(*last.values())).scalar()
    split = F.when(key <= pair["train"], "train").when(key <= pair["validation"], "validation").otherwise("test")
    return df.withColumn("split", split)


def hash_split(df: DataFrame, id_col: str, train: int = 8, validation: int = 1, of: int = 10, seed: int = 42) -> DataFrame:
    """Split by hash bucket: sizes are approximate, no pass beyond the scan."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(of))
    split = F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")
    return df.withColumn("split", split)


def running_totals(table: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each row, by ``order``, which must be total.

    Up to ``ONE_TASK`` rows are one window. More are sorted by ranges and written; then only the ranges' sums are
    one window.
    """
    def before(*by: str) -> Column:
        window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if fits(table, ONE_TASK):
        return table.withColumn(out, before())
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = saved(table.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").agg(F.sum(value).alias("_sum"))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_lower"))
    return ranges.join(F.broadcast(sums), "_range").withColumn(out, F.col("_lower") + before("_range")).drop("_range", "_lower")


def dense_ids(counts: DataFrame, key: str, count: str, out: str) -> DataFrame:
    """0-based ids by falling count, then by hash of the key.

    A rank over all keys needs one sorted run. Here a key's id is the number
    of keys with a higher count, plus the keys in lower hash buckets of the same
    count, plus its rank in its own bucket, so that the widest window sees the
    distinct counts (at most the square root of the occurrences) or the 65,536
    buckets of one count, never all keys.
    """
    keyed = counts.withColumn("_digest", F.md5(F.col(key))).withColumn("_bucket", F.substring("_digest", 1, 4))
    sizes = keyed.groupBy(count, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_count = Window.partitionBy(count).orderBy("_bucket")
    sizes = sizes.withColumn("_below", F.sum("_n").over(in_count) - F.col("_n"))
    levels = sizes.groupBy(count).agg(F.sum("_n").alias("_level"))
    falling = Window.orderBy(F.desc(count))
    levels = levels.select(count, (F.sum("_level").over(falling) - F.col("_level")).alias("_above"))
    offsets = sizes.join(levels, count).select(count, "_bucket", (F.col("_above") + F.col("_below")).alias("_offset"))
    inside = Window.partitionBy(count, "_bucket").orderBy("_digest", key)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [count, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_digest", "_bucket", "_rank", "_offset")
    )
