"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import corpus, curation
from codeloom.plans.corpus import FILES_CTE, POINTS_SQL, VALID_SQL
from codeloom.plans.registry import query
from codeloom.plans.views import code_files, table


@query("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return curation.exact_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_copies")


@query(
    """SELECT doc_id, round(1 - len(list_distinct(l))::double / len(l), 6) AS ratio, 1 - len(list_distinct(l))::double / len(l) <= 0.3::double AS kept
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
)
def repetition_ratio(spark, sf_dir):
    ratio = curation.repetition_ratio(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio <= curation.MAX_REPETITION).alias("kept"))


MARKED = "CASE WHEN doc_id % 9 = 0 THEN concat('// Code GENERATED by a tool.', chr(10), text) ELSE text END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {MARKED} AS text FROM documents) WHERE NOT regexp_matches(lower(text), 'do not edit|auto-?generated|generated by|@generated')")
def filter_generated(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MARKED} AS text")
    return marked.filter(~curation.is_generated(F.col("text"))).select("doc_id")


STOPPED = "concat(text, CASE doc_id % 3 WHEN 0 THEN concat('</s>', text) WHEN 1 THEN concat('<|endoftext|></s>', text) ELSE '' END)"


@query(
    f"""SELECT doc_id, md5(regexp_extract(text, '(?s)^(.*?)(\n\n\n|</s>|<[|]endoftext[|]>|$)', 1)) AS digest
      FROM (SELECT doc_id, {STOPPED} AS text FROM documents)"""
)
def truncate_at_stop(spark, sf_dir):
    ended = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{STOPPED} AS text")
    return ended.select("doc_id", F.md5(curation.cut_at_stop(F.col("text"))).alias("digest"))


@query(f"{FILES_CTE} SELECT doc_id FROM files WHERE {POINTS_SQL} + CASE WHEN {VALID_SQL} THEN 2 ELSE 0 END >= 3")
def filter_quality_strict(spark, sf_dir):
    """The declared threshold 0.4: three of six points."""
    return corpus.filter_quality(code_files(spark, sf_dir), 0.4).select("doc_id")
