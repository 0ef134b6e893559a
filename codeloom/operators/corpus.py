"""Corpus preparation: pick, score, filter, cap, combine, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.python_source import parses
from codeloom.operators.ranking import first_n, running_totals
from codeloom.sources.tables import saved


def with_code_text(records: DataFrame) -> DataFrame:
    """Adds ``text`` from ``content`` or ``code``; rows with neither are left out."""
    return records.withColumn("text", tx.code_text(F.col("content"), F.col("code"))).filter(F.col("text").isNotNull())


def with_language(files: DataFrame) -> DataFrame:
    return tx.pinned(files, language=tx.detect_language(F.col("text"), F.coalesce(F.col("path"), F.lit(""))))


def syntax_valid(text: Column, when: Column | None = None) -> Column:
    """True, false, or NULL where the text holds no definition keyword.

    ``when`` limits the parse to rows whose outcome matters.
    """
    gate = tx.may_be_python(text) if when is None else when & tx.may_be_python(text)
    return parses(F.when(gate, text))


def with_quality(files: DataFrame) -> DataFrame:
    """All quality metrics of a file, with points out of six and the score."""
    text = F.col("text")
    scored = files.select(
        "*",
        tx.line_count(text).alias("line_count"),
        F.length(text).alias("char_count"),
        tx.avg_line_length(text).alias("avg_line_length"),
        *[flag.alias(name) for name, flag in tx.quality_flags(text).items()],
        syntax_valid(text).alias("valid_syntax"),
    )
    flags = reduce(lambda a, b: a + b, [F.col(name).cast("int") for name in tx.QUALITY_FLAGS])
    points = tx.quality_points(flags, F.col("valid_syntax"))
    return scored.withColumn("points", points).withColumn("quality_score", tx.quality_score(F.col("points")))


def length_ok(
    text: Column, min_lines: int = tx.MIN_LINES, max_lines: int = tx.MAX_LINES,
    min_chars: int = 0, max_chars: int = tx.MAX_CHARS,
) -> Column:
    return F.length(text).between(min_chars, max_chars) & tx.line_count(text).between(min_lines, max_lines)


def filter_quality(files: DataFrame, min_quality: float = tx.MIN_QUALITY) -> DataFrame:
    """Files whose score reaches ``min_quality``.

    The parse is worth two points, so only files that miss the threshold
    without them and reach it with them are handed to the Python worker.
    """
    text = F.col("text")
    flagged = tx.pinned(files, _flags=tx.flag_points(text))
    without = tx.quality_score(tx.quality_points(F.col("_flags"), F.lit(False))) >= min_quality
    with_parse = tx.quality_score(tx.quality_points(F.col("_flags"), F.lit(True))) >= min_quality
    candidates = flagged.filter(without | (with_parse & tx.may_be_python(text)))
    return candidates.filter(without | F.coalesce(syntax_valid(text, when=~without), F.lit(False))).drop("_flags")


def filter_complexity(files: DataFrame, min_score: float = tx.MIN_COMPLEXITY) -> DataFrame:
    """Files whose shape score reaches ``min_score``; a NULL text has no score and goes."""
    return files.filter(tx.complexity(F.col("text"))["complexity_score"] >= min_score)


def filter_code(files: DataFrame, min_quality: float = tx.MIN_QUALITY, **bounds: int) -> DataFrame:
    """The whole corpus filter on (text, language): cheap conditions first."""
    text = F.col("text")
    cheap = files.filter(length_ok(text, **bounds) & tx.language_keywords_ok(text, F.col("language")))
    return filter_quality(cheap, min_quality)


def capped_ingest(files: DataFrame, group: str, order: Column, cap: int, min_lines: int = tx.MIN_LINES) -> DataFrame:
    """First ``cap`` acceptable files of each group: 100 < chars < 1 MB, enough lines."""
    text = F.col("text")
    n = F.length(text)
    acceptable = files.filter((n > 100) & (n < tx.MAX_CHARS) & (tx.line_count(text) >= min_lines))
    return first_n(acceptable, [group], [order], cap)


def limited_per_source(rows: DataFrame, source: str, order: str, limit: int, keep: Column) -> DataFrame:
    """First ``limit`` lines of each source, kept if ``keep``, then ``limit`` rows over all.

    A line counts against its source's limit even if it is not kept. Sources
    are taken in name order. How many rows each source may give follows from
    the running total over one row per source, so no global sort of rows.
    """
    read = first_n(rows, [source], [F.col(order)], limit, "_line").drop("_line").filter(keep)
    return cap_in_order(read, source, order, limit)


def cap_in_order(rows: DataFrame, source: str, order: str, limit: int) -> DataFrame:
    """First ``limit`` rows over all sources, these in name order, the rows of one by ``order``."""
    # At most ``limit`` rows per source; written so that the input is read once.
    kept = saved(first_n(rows, [source], [F.col(order)], limit, "_place"), "limited")
    totals = running_totals(kept.groupBy(source).agg(F.count(F.lit(1)).alias("_kept")), [source], "_kept", "_before")
    allowance = totals.select(F.col(source).alias("_of"), (F.lit(limit) - F.col("_before")).alias("_room"))
    allowed = kept.join(allowance, F.col(source).eqNullSafe(F.col("_of")))
    return allowed.filter(F.col("_place") <= F.col("_room")).drop("_place", "_room", "_of")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, copies kept; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def oversample(rows: DataFrame, order: Column, times: int = 12, validation: int = 3) -> DataFrame:
    """Training rows repeated ``times``; the first few rows once more for validation."""
    train = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"), F.lit("train").alias("split"))
    held = rows.orderBy(order).limit(validation).select("*", F.lit(1).alias("copy"), F.lit("validation").alias("split"))
    return train.unionByName(held)


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per key combination with subtotals; NULL keys mark a total."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def manifest(rows: DataFrame, source: str, file: Column) -> DataFrame:
    """One line per source and file: what was written and how much of it."""
    return rows.groupBy(F.col(source).alias("source"), file.alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
