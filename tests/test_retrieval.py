import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import retrieval as rt
from codeloom.session import shared_dir
from codeloom.sources import tables


@pytest.mark.parametrize("few", [True, False])
def test_nearest_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(rt, "PACK_ROWS", 64)
    if not few:
        monkeypatch.setattr(rt, "HELD_ROWS", 50)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a large group of copies
    queries = np.vstack([vectors[100:101], vectors[5:40], rng.normal(size=(60, 8))]).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "key long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_key long, embedding array<float>")
    got = rt.nearest(v, q, k=4, broadcast_queries=1000 if few else 10).collect()
    exact = ((queries[:, None, :].astype(float) - vectors[None].astype(float)) ** 2).sum(-1).round(9)
    want = {(i, n + 1): int(k) for i, row in enumerate(exact) for n, k in enumerate(np.lexsort((np.arange(700), row))[:4])}
    assert {(r.query_key, r.rank): r.key for r in got} == want
    assert all(abs(r.score - exact[r.query_key, r.key]) < 1e-9 for r in got)


def test_many_queries_are_not_copied_by_shuffle(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))]
    rows += [(900, [float("nan")] * 4)]  # hides no other vector of its block
    v = spark.createDataFrame(rows, "key long, embedding array<float>").repartition(3)
    near = rt.nearest(v, v.filter("key < 300").withColumnRenamed("key", "query_key"), k=2, broadcast_queries=10)
    plan = near._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert "CartesianProduct" in plan and exchanges and not [line for line in exchanges if "lane" in line or "_keys" in line]
    got = near.collect()
    assert len(got) == 600 and all(r.key == r.query_key and r.score == 0.0 for r in got if r.rank == 1)


def test_fewer_vectors_than_asked_for(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "key long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_key long, embedding array<float>")
    assert [tuple(r) for r in rt.nearest(v, q, k=5).select("query_key", "key", "score", "rank").collect()] == [(7, 1, 1.0, 1)]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "id int, text string")
    got = {r.id: r.embedding for r in rt.embed_text(df, dims=16).collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx(sorted([1 / 5**0.5, 2 / 5**0.5])) and got[2] == [0.0] * 16
    own = rt.embed_text(df, model=lambda t: F.array(F.length(t).cast("float")))
    assert {r.id: r.embedding for r in own.collect()} == {1: [5.0], 2: [0.0]}


def test_context_and_index_growth(spark):
    found = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_key int, rank int, text string")
    queries = spark.createDataFrame([(1, "code"), (2, None)], "query_key int, code string")
    got = {r.query_key: r.context for r in rt.assemble_context(found, queries).collect()}
    assert got == {1: rt.CONTEXT_HEADER + "first\n\nsecond\n\ncode", 2: rt.CONTEXT_HEADER}

    def chunks(*keys):
        rows = [(k, f"text {k}") for k in keys]
        meta = tables.metadata(F.lit("doc"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("f"))
        return spark.createDataFrame(rows, "key string, text string").withColumn("metadata", meta)

    path = shared_dir(spark, "index-test")
    # The last part is written twice, as after a failure.
    for part, keys in (("1", ("a", "b", "a")), ("2", ("b", "c")), ("2", ("b", "c"))):
        tables.grow_index(spark, chunks(*keys), lambda c: rt.embed_text(c, dims=8), path, f"p{part}")
    index = tables.read_index(spark, path)
    assert sorted(r.key for r in index.collect()) == ["a", "b", "c"]
    one = rt.embed_text(spark.createDataFrame([(1, "text b")], "query_key long, text string"), dims=64)
    wide = rt.embed_text(index.drop("embedding"), dims=64)
    assert rt.retrieve(wide, one, k=1).select("key", "rank", "metadata.file").collect()[0][:] == ("b", 1, "f")
