"""File scans: JSONL records, source trees, run results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from codeloom.functions import text as tx
from codeloom.operators.segments import CODE_SUFFIXES, DOC_SUFFIXES
from codeloom.schemas import RUN_RESULT
from codeloom.sources.tables import saved

MAX_FILE_BYTES = 1 << 30  # a text must fit into one value of a row
RECORD_FIELDS = ("id", "path", "content", "code", "language", "license")


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Record fields of JSON lines, and ``rejected``: the line itself if it is no JSON object.

    An empty ``content`` (null, "", 0, false, [] or {}) leaves the choice to
    ``code``. A record whose chosen text, or whose path, is neither empty nor a string
    has no text: ``content`` and ``code`` are both NULL. Of a key that is repeated the last value counts.
    """
    with tx.last_key_counts(lines.sparkSession):
        variant = tx.pinned(lines, _v=F.try_parse_json(F.col(value)))
    is_object = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))

    # Fields and their kinds are computed once; the rules below read columns only.
    chosen_from = ("content", "code", "path")
    fields = {f"_f_{name}": F.try_variant_get("_v", f"$.{name}", "variant") for name in chosen_from}
    variant = tx.pinned(variant, **fields)
    read = {f"_t_{name}": F.when(F.schema_of_variant(f"_f_{name}") == "STRING", F.try_variant_get("_v", f"$.{name}", "string")) for name in chosen_from}
    zero = {f"_z_{name}": F.when(F.schema_of_variant(f"_f_{name}") != "STRING", F.try_variant_get("_v", f"$.{name}", "double")) == 0 for name in chosen_from}
    empty = {f"_e_{name}": F.coalesce(F.to_json(f"_f_{name}").isin('""', "false", "[]", "{}", "null"), F.lit(True)) for name in chosen_from}
    variant = tx.pinned(variant, **read, **zero, **empty)

    def text_field(name: str) -> Column:
        if name in chosen_from:
            return F.col(f"_t_{name}")
        field = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))

    def filled(name: str) -> Column:
        return ~F.col(f"_e_{name}") & ~F.coalesce(F.col(f"_z_{name}"), F.lit(False))

    def usable(name: str) -> Column:
        return ~filled(name) | text_field(name).isNotNull()

    content = F.when(usable("path") & filled("content"), text_field("content"))
    code = F.when(usable("path") & usable("content"), text_field("code"))
    chosen = {"content": content, "code": code}
    rejected = F.when(F.col("_v").isNull() | ~is_object, F.col(value))
    keep = [name for name in lines.columns if name != value]
    return variant.select(*keep, *[chosen.get(name, text_field(name)).alias(name) for name in RECORD_FIELDS], rejected.alias("rejected"))


def _numbered_lines(lines: DataFrame, limit: int | None) -> DataFrame:
    """(value, file, line): the 0-based number of a line in its file, however the file was split.

    A task counts the lines of each split of a file as they come, and stops passing them on at ``limit``;
    what is before a split follows from the counts of the file's earlier splits. The lines are
    written once, so that numbers do not change when a task is run again.
    """
    schema = T.StructType.fromDDL("value string, file string, _start bigint, _n bigint")
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = None, 0
        for batch in batches:
            files_, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            numbers = np.empty(len(files_), np.int64)
            for i, here in enumerate(zip(files_, starts)):
                if here != split:
                    split, seen = here, 0
                numbers[i] = seen
                seen += 1
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], schema=arrow)
            yield made if limit is None else made.filter(pc.less(made.column(3), limit))

    kept = saved(lines.mapInArrow(count, schema), "lines")
    splits = kept.groupBy("file", "_start").agg((F.max("_n") + 1).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "_start", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    numbered = kept.join(before, ["file", "_start"]).select("value", "file", (F.col("_before") + F.col("_n")).alias("line"))
    return numbered if limit is None else numbered.filter(F.col("line") < limit)


def scan_jsonl(spark: SparkSession, folder: str, numbered: bool = False, limit: int | None = None) -> DataFrame:
    """All lines of all ``*.jsonl`` below a folder, parsed, with their file; the first ``limit`` of each file, if given.

    A name with the suffix may also be a folder of parts, as Spark writes it; each part is a file. With
    ``numbered``, or a limit, ``line`` is the line's 0-based number in its file.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    lines = lines.select("value", path.alias("file"), F.col("_metadata.file_block_start").alias("_start"), path.rlike(r"\.jsonl(/|\z)").alias("_in")).filter("_in").drop("_in")
    return parse_records(_numbered_lines(lines, limit) if numbered or limit is not None else lines.drop("_start"))


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable records, and the rejected lines as a side table."""
    return records.filter("rejected IS NULL").drop("rejected"), records.filter("rejected IS NOT NULL").select("file", "rejected")


def readable(raw: Column) -> Column:
    """Text of a file as read with bad bytes left out and line ends made ``\\n``."""
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")))
    return F.regexp_replace(valid, "\r\n?", "\n")


def _known_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ext, length) of the files below a folder, from their listing; nothing is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = tx.suffix(F.col("_metadata.file_name"))
    return found.select(F.col("_metadata.file_path").alias("file"), ext.alias("ext"), "length").filter(F.col("ext").isin(CODE_SUFFIXES + DOC_SUFFIXES))


def _read_files(spark: SparkSession, folder: str) -> DataFrame:
    ext, size = tx.suffix(F.col("_metadata.file_name")), F.col("_metadata.file_size")
    read = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(folder, wholetext=True)
    return read.filter(ext.isin(CODE_SUFFIXES + DOC_SUFFIXES) & (size <= MAX_FILE_BYTES)).select("value", F.col("_metadata.file_path").alias("file"), ext.alias("ext"))


def _plain_path(file: Column) -> Column:
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Code and document files below a folder: path, kind, text.

    Files of other kinds are left out by name before they are opened, files of more than
    ``MAX_FILE_BYTES`` by their size; these, and files that cannot be read, are in ``rejected_files``.
    """
    found = _read_files(spark, folder)
    return found.select(_plain_path(F.col("file")).alias("path"), F.when(F.col("ext").isin(DOC_SUFFIXES), "doc").otherwise("code").alias("kind"), readable(F.col("value")).alias("text"))


def rejected_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, reason) of the code and document files below a folder that ``scan_tree`` does not give.

    The listing without the files that were read; of these only paths are shuffled. Empty files are no rows of a
    text scan and hold nothing, so they are not listed here.
    """
    left = _known_files(spark, folder).filter("length > 0").join(_read_files(spark, folder).select("file"), "file", "left_anti")
    reason = F.when(F.col("length") > MAX_FILE_BYTES, F.lit(f"longer than {MAX_FILE_BYTES} bytes")).otherwise("cannot be read")
    return left.select(_plain_path(F.col("file")).alias("path"), "length", reason.alias("reason"))


def present(spark: SparkSession, folders: Sequence[str]) -> tuple[list[str], list[str]]:
    """The folders that exist, and those that do not."""
    found, missing = [], []
    for folder in folders:
        try:
            spark.read.format("binaryFile").load(folder)
            found.append(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(folder)
    return found, missing


def write_runs(runs: DataFrame, folder: str) -> None:
    runs.write.mode("append").json(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_RESULT).json(folder)
