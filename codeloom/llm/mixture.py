"""Mixing sources to target weights by weighted sampling without replacement.

Every document has the key ``u ** (1 / quality)`` of a uniform ``u`` drawn from
its id and text, taken in falling order (equally: an exponential of rate ``quality``,
rising). A source whose target is ``e`` times its size and a rest gives ``e``
complete epochs, and the documents before the rest is reached in key order.

The cut is found without sorting a source: two histograms over the key narrow
it to one part in 2**24 of the source, and only those rows are ranked.

NULL text has size 0; NULL source is a source of its own, last in order. Rows with
the same doc_id and text have one key and are counted together; where the cut falls
among them, they are numbered and taken one by one. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.rows import fresh
from codeloom.sources.tables import saved

FAN = 4096
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def default_quality(text: Column, size: Column) -> Column:
    """Half weight for texts whose words are unusually short or long on average."""
    usual = (F.length(text) >= 4 * size) & (F.length(text) <= 12 * size)
    return F.when(usual, 1.0).otherwise(0.5)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``place`` of each source by code point, NULL last, counted from 0 over sorted ranges."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").isNull(), F.col("source")
    placed = saved(
        sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sources"
    ).withColumn("_part", F.shiftright("_id", 33))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_part").withColumn("place", place).drop("_id", "_part", "_before")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """``target`` per source (source, source_size): shares by weight, none above ``most`` sizes.

    The excess is shared again among the others until nobody is above; a round
    takes two sums from the sources, whatever their number.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = saved(ranked_sources(sources).withColumn("weight", weight), "weighted")
    top = most * F.col("source_size")
    total, free = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    full, held = -1, 0
    while total and free and full != held:
        level, full = (total - held) / free, held
        above = F.col("weight") * F.lit(level) > top
        held, free = placed.agg(F.coalesce(F.sum(F.when(above, top)), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
    level = level if total else 0.0
    return placed.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), top.cast("double")).alias("target"))


def drawn(docs: DataFrame, columns: Sequence[str], weights: Sequence[float] = (1, 2, 3), quality: Column | None = None, seed: int = 7, most: int = MOST_EPOCHS) -> DataFrame:
    """Every row of ``docs`` as row (a struct of ``columns``), size, source_size, target and times (how often it is taken).

    ``quality`` is a positive weight from columns of ``docs`` and ``size``.
    """
    text = F.col("text").cast("string")
    row = fresh(docs, "row")
    sized = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in columns])).withColumn("_size", word_count(text))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), words).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rate = quality if quality is not None else default_quality(text, F.col("_size"))
    key = 1 - F.pow(uniform, 1 / F.coalesce(rate, F.lit(1.0)))
    sized = sized.select(
        F.col(row).alias("row"), F.col("source").cast("string").alias("source"), F.col("_size").alias("size"), key.alias("_key"),
        F.struct(key.alias("key"), name.alias("name"), F.col("_size").alias("size"), words.alias("words")).alias("_g"), F.monotonically_increasing_id().alias("_id"),
    )
    fine = F.floor(F.col("_key") * (FAN * FAN))
    # Saved with its number, so that a row is the same one in each step below.
    sized = saved(sized, "sizes").withColumn("_b", F.floor(fine / FAN)).withColumn("_c", fine % FAN).withColumn("_p", F.shiftright("_id", 33))
    sources = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    def crossing(rows: DataFrame, bucket: str) -> DataFrame:
        """The bucket in which the running size passes the rest; rows of a bucket are summed before they meet."""
        sums = rows.groupBy("source", "rest", bucket).agg(F.sum("size").alias("_n"))
        running = Window.partitionBy("source").orderBy(bucket)
        sums = sums.withColumn("_end", F.sum("_n").over(running)).withColumn("_begin", F.col("_end") - F.col("_n"))
        return sums.filter("_begin <= rest AND rest < _end").select("source", F.col(bucket).alias(f"{bucket}x"), (F.col("rest") - F.col("_begin")).alias("_left"))

    def on_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    # Each step narrows the cut: by two histograms, then to equal rows, to equal rows of one part, and to one row.
    near, plan = on_source(sized.drop("row"), sources.select("source", "rest")), sources
    for bucket in ("_b", "_c", "_g", "_p"):
        found = saved(crossing(near, bucket), "crossing")
        near = on_source(near.drop("rest"), found).filter(f"{bucket} = {bucket}x").drop(f"{bucket}x").withColumnRenamed("_left", "rest")
        plan = on_source(plan, found.drop("_left"))
    order = Window.partitionBy("source").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The document that crosses the rest is taken if more than half of it lies before.
    last = near.withColumn("_sum", F.sum("size").over(order)).filter(F.col("_sum") - F.col("size") / 2 <= F.col("rest"))
    plan = saved(on_source(plan, last.groupBy("source").agg(F.max("_id").alias("_cut"))), "cuts")
    before = F.col("_id") <= F.col("_cut")
    for bucket in ("_p", "_g", "_c", "_b"):
        before = (F.col(bucket) < F.col(f"{bucket}x")) | ((F.col(bucket) == F.col(f"{bucket}x")) & F.coalesce(before, F.lit(False)))
    part = F.when((F.col("rest") > 0) & (F.col("_bx").isNull() | F.coalesce(before, F.lit(False))), 1).otherwise(0)
    return on_source(sized, plan).select("row", "size", "source_size", "target", (F.col("epochs") + part).alias("times"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), quality: Column | None = None, seed: int = 7, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of every document."""
    found = drawn(docs, ["doc_id"], weights, quality, seed, most)
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"))
