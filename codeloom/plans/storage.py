"""Source and sink queries: written from the tables, read back, counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import jobs
from codeloom.functions import text as tx
from codeloom.operators import corpus, ranking
from codeloom.plans.corpus import FILTER_SQL, FILES_CTE, SPLIT_SQL
from codeloom.plans.registry import query
from codeloom.plans.tokens import ENCODED_CTE, encoded, tokens_sql
from codeloom.plans.views import code_files, md5_list, table
from codeloom.session import shared_dir
from codeloom.sources import files, tables


def written_records(spark, sf_dir) -> str:
    """All code files as JSONL: ``content`` or ``code``, with further lines of broken records and non-texts between them."""
    records = code_files(spark, sf_dir).select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), "path",
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("content"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("code"), "doc_id",
    )
    bad = (
        F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit('{"id": "broken '), "doc_id"))
        .when(F.col("doc_id") % 10 == 7, F.concat(F.lit('{"id": "doc_'), "doc_id", F.lit('", "content": 7}')))
        .when(F.col("doc_id") % 20 == 3, F.to_json(F.struct("id", "path", F.lit(5).alias("content"), "code")))
        .when(F.col("doc_id") % 20 == 13, F.to_json(F.struct("id", F.array("doc_id").alias("path"), "content", "code")))
        .when(F.col("doc_id") % 10 == 5, F.concat(F.lit("["), "doc_id", F.lit("]")))
    )
    # An empty ``content`` before a filled ``code`` is as good as none.
    good = F.when(F.col("doc_id") % 20 == 1, F.to_json(F.struct("id", "path", F.lit(0).alias("content"), "code"))).otherwise(F.to_json(F.struct("id", "path", "content", "code")))
    folder = shared_dir(spark, "records")
    lines = records.select(F.explode(F.array_compact(F.array(good, bad))).alias("value"))
    lines.write.option("compression", "none").text(f"{folder}/raw.jsonl")
    return folder


@query(
    f"""{FILES_CTE} SELECT concat('doc_', doc_id) AS id, language, length(text) AS n_chars, CAST(NULL AS varchar) AS rejected FROM files
        WHERE {FILTER_SQL}
      UNION ALL SELECT NULL, NULL, NULL, concat('{{"id": "broken ', doc_id) FROM documents WHERE doc_id % 10 = 9
      UNION ALL SELECT NULL, NULL, NULL, concat('[', doc_id, ']') FROM documents WHERE doc_id % 10 = 5"""
)
def src_jsonl_scan(spark, sf_dir):
    """JSONL folder to filtered files, with unreadable lines as a side table."""
    folder = written_records(spark, sf_dir)
    good, rejected = files.split_rejects(files.scan_jsonl(spark, folder))
    kept = corpus.filter_code(corpus.with_language(corpus.with_code_text(good)))
    return corpus.union_sources(kept.select("id", "language", F.length("text").alias("n_chars")), rejected.select("rejected"))


TOKENS_LEN = "len(" + tokens_sql("concat('<|code|>', text, '<|endoftext|>')") + ")"


@query(
    f"""{FILES_CTE} SELECT language, count(*) AS n_rows, CAST(sum(least(512, {TOKENS_LEN})) AS bigint) AS n_tokens,
        count(*) FILTER ({TOKENS_LEN} > 512) AS n_truncated FROM files WHERE {FILTER_SQL} GROUP BY language"""
)
def build_corpus_job(spark, sf_dir):
    """Raw JSONL to the written split set, summed up per language."""
    built = jobs.build_corpus(spark, written_records(spark, sf_dir), shared_dir(spark, "corpus"))
    return built.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("token_count").alias("n_tokens"), F.count_if("truncated").alias("n_truncated")
    )


@query("SELECT concat(item_id) AS item, length(text) + 1 AS n_chars, 'doc' AS kind, md5(concat(text, chr(10))) AS digest FROM benchmark")
def src_tree_scan(spark, sf_dir):
    """Every benchmark item as a file of its own in a folder tree, then scanned."""
    folder = shared_dir(spark, "tree")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    items.write.partitionBy("item_id").text(folder)
    found = files.scan_tree(spark, folder)
    item = F.regexp_extract("path", "item_id=([0-9]+)/", 1)
    return found.select(item.alias("item"), F.length("text").alias("n_chars"), "kind", F.md5("text").alias("digest"))


@query(
    f"""SELECT lang, split, count(*) AS n_rows, CAST(sum(length(text)) AS bigint) AS n_chars
      FROM documents JOIN ({SPLIT_SQL}) USING (doc_id) GROUP BY lang, split"""
)
def sink_jsonl_partitioned(spark, sf_dir):
    folder = shared_dir(spark, "jsonl")
    tables.write_jsonl(ranking.ratio_split(table(spark, sf_dir, "documents"), "doc_id"), folder, "lang", "split")
    back = spark.read.schema("doc_id bigint, text string, lang string, split string").json(folder)
    return back.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query(
    f"""{ENCODED_CTE} SELECT doc_id, split, md5(array_to_string(ids, ',')) AS digest, token_count AS n_real FROM encoded JOIN ({SPLIT_SQL}) USING (doc_id)"""
)
def sink_splits(spark, sf_dir):
    """Token ids of every document, written by split and read back."""
    ids, _ = encoded(spark, sf_dir)
    folder = shared_dir(spark, "splits")
    tables.write_splits(ranking.ratio_split(tables.saved(ids, "encoded"), "doc_id"), folder)
    back = tables.read_splits(spark, folder)
    return back.select("doc_id", "split", md5_list("input_ids").alias("digest"), F.size("attention_mask").alias("n_real"))


@query(f"SELECT split, count(*) AS n_rows, CAST(sum(len(string_split(text, chr(10)))) AS bigint) AS n_lines FROM documents JOIN ({SPLIT_SQL}) USING (doc_id) GROUP BY split")
def load_splits_checked(spark, sf_dir):
    """Split text set, checked for its columns on load."""
    folder = shared_dir(spark, "texts")
    tables.write_splits(ranking.ratio_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), folder)
    back = tables.read_splits(spark, folder, required=("doc_id", "text"))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(tx.line_count(F.col("text"))).cast("bigint").alias("n_lines"))


WORST = "worst"  # a source that cannot be read


@query(
    f"""SELECT lang AS source, count(*) AS n_rows, CAST(sum(length(text)) AS bigint) AS n_chars, count(*) AS n_read, false AS failed FROM documents GROUP BY lang
      UNION ALL SELECT '{WORST}', NULL, NULL, 0, true"""
)
def manifest_written(spark, sf_dir):
    """Documents written per language, with what the writes counted, what is read back, and the source that failed."""
    docs = table(spark, sf_dir, "documents")
    languages = [r.lang for r in docs.select("lang").distinct().collect()]
    sources = {lang: docs.filter(F.col("lang") == lang).select("doc_id", "text") for lang in languages}
    sources[WORST] = docs.select("doc_id", F.raise_error(F.lit("no such source")).cast("string").alias("text"))
    folder = shared_dir(spark, "sources")
    manifest = tables.write_sources(sources, folder)
    paths = [f"{folder}/{lang}" for lang in languages]
    back = spark.read.schema("doc_id bigint, text string").json(paths).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source")).agg(F.count(F.lit(1)).alias("n_read"))
    told = manifest.join(back, "source", "left")
    return told.select("source", "n_rows", "n_chars", F.coalesce("n_read", F.lit(0)).alias("n_read"), F.coalesce(F.contains("error", F.lit("no such source")), F.lit(False)).alias("failed"))
