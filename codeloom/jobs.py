"""The end-to-end jobs: raw records to a split token set, a source tree to a search index."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import corpus, ranking, retrieval, segments
from codeloom.operators import tokens as tk
from codeloom.sources import files, tables


def build_corpus(spark: SparkSession, raw_folder: str, out: str, max_length: int = tk.MAX_LENGTH, limit: int | None = None) -> DataFrame:
    """JSONL below a folder to curated, tokenised examples, written by split.

    Gives the set as read back: example_id, text, language, input_ids,
    attention_mask, token_count, truncated, split. The vocabulary lies next to
    it in ``<out>-vocabulary``. An example's id is its file and line, so that a rerun gives the same
    ids and splits on any cluster. With ``limit``, that many lines of each file are read, and
    that many examples kept, files in name order. The ids are split before texts are tokenised.
    """
    records, _ = files.split_rejects(files.scan_jsonl(spark, raw_folder, numbered=True, limit=limit))
    kept = corpus.filter_code(corpus.with_language(corpus.with_code_text(records)))
    if limit is not None:
        kept = corpus.cap_in_order(kept.select("file", "line", "text", "language"), "file", "line", limit)
    kept = tables.saved(kept.select(F.concat_ws(":", "file", "line").alias("example_id"), "text", "language"), "kept")
    tk.build_vocabulary(kept).write.mode("overwrite").parquet(f"{out}-vocabulary")
    vocabulary = spark.read.parquet(f"{out}-vocabulary")
    split = ranking.ratio_split(kept, "example_id")
    examples = tk.encode(split, vocabulary, "example_id", max_length=max_length, keep=("text", "language", "split"))
    tables.write_splits(examples, out)
    return tables.read_splits(spark, out)


def build_index(spark: SparkSession, folders: list[str], path: str, **embedding) -> DataFrame:
    """Code and documents below the folders to a search index of their chunks; missing folders are skipped with a warning."""
    folders, missing = files.present(spark, folders)
    if missing:
        warnings.warn(f"skipped, as they do not exist: {', '.join(missing)}", stacklevel=2)
    if not folders:
        raise ValueError("none of the folders exists")
    found = corpus.union_sources(*[files.scan_tree(spark, folder) for folder in folders])
    pieces = segments.explode_pieces(segments.project_chunks(found), "chunks", "path")
    chunks = pieces.select(
        F.concat_ws(":", "path", "piece").alias("key"),
        "text",
        tables.metadata(*map(F.col, ("type", "name", "start", "end", "path"))).alias("metadata"),
    )
    tables.write_index(retrieval.embed_text(chunks, **embedding), path)
    return tables.read_index(spark, path)


def contexts(index: DataFrame, questions: DataFrame, k: int = 3, **embedding) -> DataFrame:
    """``context`` for every question (query_key, text, code) from the index."""
    asked = retrieval.embed_text(questions, **embedding)
    return retrieval.assemble_context(retrieval.retrieve(index, asked, k), questions)
