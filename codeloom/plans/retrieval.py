"""Embedding, neighbour search and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import neighbours as nb
from codeloom.operators import retrieval as rt
from codeloom.operators import segments as sg
from codeloom.plans.registry import query
from codeloom.plans.segments import windows_sql
from codeloom.plans.tokens import tokens_sql
from codeloom.plans.views import documents, table
from codeloom.session import shared_dir
from codeloom.sources import tables

DIMS = 64
K = 3


def vectors_sql(relation: str, key: str) -> str:
    """Dense vectors of a relation with ``text``: columns (key, v), v a list of doubles."""
    return f"""(SELECT key, list(coalesce(x, 0) ORDER BY d) AS v FROM (
      SELECT k.key, k.d, CAST(CAST(c.n / sqrt(sum(c.n * c.n) OVER (PARTITION BY k.key)) AS float) AS double) AS x FROM
        (SELECT {key} AS key, unnest(range({DIMS})) AS d FROM {relation}) k LEFT JOIN
        (SELECT key, b, CAST(count(*) AS double) AS n FROM (SELECT key, CAST('0x' || substr(md5(token), 1, 4) AS int) % {DIMS} AS b
          FROM (SELECT {key} AS key, unnest({tokens_sql('text')}) AS token FROM {relation})) GROUP BY key, b) c
        ON k.key = c.key AND k.d = c.b) GROUP BY key)"""


def nearest_sql(vectors: str, queries: str, k: int) -> str:
    return f"""SELECT query_key, key, score, row_number() OVER (PARTITION BY query_key ORDER BY score, key) AS rank FROM (
      SELECT q.key AS query_key, v.key AS key,
        round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.v[i] - q.v[i]) ** 2)), 9) AS score FROM {vectors} v, {queries} q)
      QUALIFY rank <= {k}"""


@query(
    f"""SELECT key AS doc_id, d AS dim, round(v[d + 1], 6) AS value FROM (
      SELECT key, v, unnest(range({DIMS})) AS d FROM {vectors_sql('documents', 'doc_id')}) WHERE v[d + 1] <> 0"""
)
def embed_text(spark, sf_dir):
    vectors = rt.embed_text(documents(spark, sf_dir), dims=DIMS)
    values = tx.unnest(vectors, F.col("embedding"), "doc_id", pos="dim", item="x").filter("x <> 0")
    return values.select("doc_id", "dim", F.round(F.col("x").cast("double"), 6).alias("value"))


@query(
    f"""WITH vec AS (SELECT vec_id AS key, CAST(embedding AS double[]) AS v FROM embeddings), near AS ({nearest_sql('vec', 'vec', 5)})
      SELECT query_key, key, rank, round(score, 6) AS score FROM near"""
)
def knn_l2_topk(spark, sf_dir):
    """The five nearest vectors of every vector in the table."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    near = rt.nearest(vectors, vectors.withColumnRenamed("key", "query_key"), k=5)
    return near.select("query_key", "key", "rank", F.round("score", 6).alias("score"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


@query(
    f"""WITH vec AS (SELECT vec_id AS key, CAST(embedding AS double[]) AS v FROM embeddings), near AS ({nearest_sql('vec', 'vec', 5)})
      SELECT query_key, key, rank, round(score, 6) AS score FROM near"""
)
def knn_pivot_index(spark, sf_dir):
    """As ``knn_l2_topk``, by the search for many queries."""
    near = nb.nearest(nb.build(vectors(spark, sf_dir)), vectors(spark, sf_dir).withColumnRenamed("key", "query_key"), k=5)
    return near.select("query_key", "key", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH vec AS (SELECT vec_id AS key, CAST(embedding AS double[]) AS v FROM embeddings)
      SELECT query_key, key, round(score, 6) AS score FROM (SELECT q.key AS query_key, v.key AS key,
        round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.v[i] - q.v[i]) ** 2)), 9) AS score FROM vec v, vec q)
      WHERE score <= {nb.max_distance()}"""
)
def knn_threshold(spark, sf_dir):
    """All pairs of vectors at least as similar as declared."""
    near = nb.within(nb.build(vectors(spark, sf_dir)), vectors(spark, sf_dir).withColumnRenamed("key", "query_key"), nb.max_distance())
    return near.select("query_key", "key", F.round("score", 6).alias("score"))


def keyed_chunks(pieces):
    return pieces.select(
        F.concat_ws(":", "doc_id", "start").alias("key"),
        "text",
        tables.metadata(F.col("type"), F.col("name"), F.col("start"), F.col("end"), F.col("doc_id").cast("string")).alias("metadata"),
    )


def index(spark, sf_dir):
    """Line chunks of all documents with their vectors, as a written index."""
    chunked = documents(spark, sf_dir).select("doc_id", sg.line_chunks(F.col("text")).alias("chunks"))
    path = shared_dir(spark, "index")
    tables.write_index(rt.embed_text(keyed_chunks(sg.explode_pieces(chunked, "chunks", "doc_id")), dims=DIMS), path)
    return tables.read_index(spark, path)


def search(spark, sf_dir):
    chunks = index(spark, sf_dir)
    queries = rt.embed_text(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_key"), "text"), dims=DIMS)
    return rt.retrieve(chunks, queries, k=K)


FOUND_CTE = f"""WITH chunks AS (SELECT concat(doc_id, ':', s) AS key, doc_id, s, t AS text FROM ({windows_sql('documents')})),
    vec AS {vectors_sql('chunks', 'key')}, qvec AS {vectors_sql('benchmark', 'item_id')},
    found AS (SELECT * FROM ({nearest_sql('vec', 'qvec', K)}) JOIN chunks USING (key))"""


@query(f"""{FOUND_CTE} SELECT query_key, rank, key, round(score, 6) AS score, doc_id::varchar AS file, s AS start, md5(text) AS digest FROM found""")
def retrieve_chunks(spark, sf_dir):
    return search(spark, sf_dir).select(
        "query_key", "rank", "key", F.round("score", 6).alias("score"), "metadata.file", "metadata.start", F.md5("text").alias("digest")
    )


@query(
    f"""WITH chunks AS (SELECT concat(doc_id, ':', s) AS key, t AS text FROM ({windows_sql('documents')})),
      vec AS {vectors_sql('chunks', 'key')}, qvec AS {vectors_sql('benchmark', 'item_id')}
      SELECT q.key AS query_key, v.key AS key, round(round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.v[i] - q.v[i]) ** 2)), 9), 6) AS score FROM vec v, qvec q
      WHERE round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.v[i] - q.v[i]) ** 2)), 9) <= {nb.max_distance()}"""
)
def retrieve_similar_chunks(spark, sf_dir):
    """Every chunk at least as similar to a benchmark item as declared, however many there are."""
    queries = rt.embed_text(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_key"), "text"), dims=DIMS)
    near = nb.within(nb.build(index(spark, sf_dir)), queries, nb.max_distance())
    return near.select("query_key", "key", F.round("score", 6).alias("score"))


@query(
    f"""{FOUND_CTE} SELECT item_id, md5(concat('# Relevant context from project:', chr(10),
        coalesce(string_agg(found.text, chr(10) || chr(10) ORDER BY rank), ''),
        CASE WHEN item_id % 4 = 0 THEN '' ELSE concat(chr(10), chr(10), benchmark.text) END)) AS digest
      FROM benchmark LEFT JOIN found ON item_id = query_key GROUP BY item_id, benchmark.text"""
)
def assemble_context(spark, sf_dir):
    """Retrieved context before the code of the request, or alone if it has none."""
    requests = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_key"), F.expr("CASE WHEN item_id % 4 = 0 THEN NULL ELSE text END").alias("code")
    )
    context = rt.assemble_context(search(spark, sf_dir), requests)
    return context.select(F.col("query_key").alias("item_id"), F.md5("context").alias("digest"))


@query(
    f"""SELECT concat(doc_id, ':', s) AS key, length(t) AS n_chars, doc_id::varchar AS file, s AS start, s + 20 AS "end", {DIMS} AS dims
      FROM ({windows_sql('documents')})"""
)
def index_roundtrip(spark, sf_dir):
    chunks = index(spark, sf_dir)
    return chunks.select(
        "key", F.length("text").alias("n_chars"), "metadata.file", "metadata.start", "metadata.end", F.size("embedding").alias("dims")
    )
