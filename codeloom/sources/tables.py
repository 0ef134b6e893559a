"""Tables written to and read back from shared storage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import SPLIT_COLUMNS
from codeloom.session import fits, shared_dir

BROADCAST_KEYS = 1_000_000
MANIFEST = "source string, path string, n_rows bigint, n_chars bigint, error string"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, lineage cut."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split; a failing write raises."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, required: Sequence[str] = SPLIT_COLUMNS) -> DataFrame:
    """A split data set that holds the required columns; else an error."""
    df = spark.read.parquet(path)
    missing = [name for name in (*required, "split") if name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df


def write_jsonl(df: DataFrame, path: str, *by: str) -> None:
    """One JSONL folder per combination of ``by`` that has rows."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_index(chunks: DataFrame, path: str, part: str = "base") -> None:
    """Retrieval index: key, text, metadata and vector of a chunk in one row.

    The index is a folder of parts; writing a part again replaces it.
    """
    chunks.select("key", "text", "metadata", "embedding").write.mode("overwrite").parquet(f"{path}/part={part}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key", "text", "metadata", "embedding")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was already written to the path; only a missing or empty folder counts as none."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def grow_index(
    spark: SparkSession, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, part: str
) -> None:
    """Embeds the chunks whose key no other part holds, and writes them as ``part``.

    A part that is written again after a failure comes out the same. The keys of
    a batch go to the index where they are few, so that the index is read, key
    column only, but not shuffled.
    """
    new = saved(chunks.dropDuplicates(["key"]), "new-chunks")
    if exists(spark, path):
        held = spark.read.parquet(path).filter(F.col("part") != part).select("key")
        if fits(new.select("key"), BROADCAST_KEYS):
            held = F.broadcast(held.join(F.broadcast(new.select("key")), "key", "left_semi").distinct())
        new = new.join(held, "key", "left_anti")
    write_index(embed(new), path, part)


def metadata(kind: Column, name: Column, start: Column, end: Column, file: Column) -> Column:
    return F.struct(
        kind.alias("type"), name.alias("name"), start.alias("start"), end.alias("end"), file.alias("file")
    )


def write_sources(sources: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Writes each source as JSONL below ``folder``, and what was written as a manifest next to them.

    The rows are counted by the write itself. A source that fails does not stop the others: its line has
    the error, and no count. Gives the manifest, (source, path, n_rows, n_chars, error), as read back.
    """
    spark = next(iter(sources.values())).sparkSession
    lines = []
    for name, rows in sources.items():
        path, seen = f"{folder}/{name}", Observation()
        text = F.coalesce(F.sum(F.length("text")), F.lit(0)) if "text" in rows.columns else F.lit(None)
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), text.cast("bigint").alias("n_chars")).write.mode("overwrite").json(path)
            lines.append((name, path, seen.get["n_rows"], seen.get["n_chars"], None))
        except (PySparkException, Py4JJavaError) as error:
            lines.append((name, path, None, None, str(error).strip().splitlines()[0]))
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")
