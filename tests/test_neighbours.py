import numpy as np
import pytest
from codeloom.operators import neighbours as nb
from codeloom.operators import retrieval as rt

FIELDS = "key string, embedding array<float>"


def clustered(seed, n, dims=8, centres=12, spread=0.05):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    return (middle[draw.integers(centres, size=n)] + spread * draw.normal(size=(n, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def tables(spark):
    vectors = clustered(1, 3000)
    vectors[100:140] = vectors[100]  # copies
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(vectors)]
    asked = np.concatenate([vectors[:150], clustered(2, 50), 50 + clustered(3, 5)]).astype(np.float32)
    odd = [("null", None), ("nan", [float("nan")] * 8), ("gap", [None] + [0.0] * 7), ("none", [])]
    v = spark.createDataFrame(rows + odd, FIELDS).repartition(6)
    q = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(asked)] + odd, FIELDS.replace("key", "query_key")).repartition(3)
    scores = np.round(((asked[:, None].astype(np.float64) - vectors[None].astype(np.float64)) ** 2).sum(axis=2), 9)
    return v, q, scores


@pytest.mark.parametrize("lane_rows", [65_536, 40])
def test_all_within_a_distance(monkeypatch, tables, lane_rows):
    monkeypatch.setattr(nb, "LANE_ROWS", lane_rows)
    v, q, scores = tables
    index = nb.build(v)
    assert index.sizes.sum() == scores.shape[1] and len(index.buckets) <= nb.PIVOTS * nb.RINGS
    for distance in (0.0, 0.02, 0.5):
        found = nb.within(index, q, distance).collect()
        expected = {(f"q{a}", f"v{b}"): scores[a, b] for a, b in zip(*np.nonzero(scores <= distance))}
        assert len(found) == len(expected) and {(r.query_key, r.key): r.score for r in found} == expected
    share = nb.compared_share(index, q, 0.02).first()
    assert share.n_pairs == scores.size and 0 < share.share < 0.5


@pytest.mark.parametrize("lane_rows, k", [(65_536, 5), (40, 5), (65_536, 4000)])
def test_nearest_of_many_queries(monkeypatch, tables, lane_rows, k):
    monkeypatch.setattr(nb, "LANE_ROWS", lane_rows)
    v, q, scores = tables
    q = q.filter("query_key LIKE 'q%'")
    if k > 1000:
        q, scores = q.filter("query_key IN ('q0', 'q1')"), scores[:2]
    found = nb.nearest(nb.build(v), q, k).collect()
    names = np.array([f"v{i}" for i in range(scores.shape[1])])
    for a in range(len(scores)):
        own = sorted((r.rank, r.key, r.score) for r in found if r.query_key == f"q{a}")
        order = sorted(range(len(names)), key=lambda b: (scores[a, b], names[b]))[:k]
        assert own == [(i + 1, names[b], scores[a, b]) for i, b in enumerate(order)]


def test_same_as_flat_search(spark, tables):
    v, q, _ = tables
    v, q = v.filter("key LIKE 'v%'"), q.filter("query_key LIKE 'q%'")
    assert sorted(nb.nearest(nb.build(v), q, 3).collect()) == sorted(rt.nearest(v, q, 3).select("query_key", "key", "score", "rank").collect())


def test_empty_tables_and_one_point(spark):
    none = spark.createDataFrame([], FIELDS)
    one = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], FIELDS)
    asked = one.withColumnRenamed("key", "query_key")
    assert nb.within(nb.build(none), asked, 1.0).collect() == [] and nb.nearest(nb.build(none), asked, 2).collect() == []
    assert nb.within(nb.build(one), none.withColumnRenamed("key", "query_key"), 1.0).collect() == []
    assert len(nb.within(nb.build(one), asked, 0.0).collect()) == 4
    assert nb.compared_share(nb.build(none), asked, 1.0).first().n_compared == 0
    with pytest.raises(ValueError):
        nb.within(nb.build(one), asked, -1.0)


def shuffled_bytes(df):
    """Rows it has, and bytes of the rows that its shuffles wrote."""
    n, total, plans = len(df.collect()), 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += plan.metrics().apply("dataSize").value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(name)
        plans += [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return n, total


def test_queries_are_not_copied_to_the_buckets_they_reach(spark):
    vectors = np.random.default_rng(4).normal(size=(2000, 64)).astype(np.float32)  # spread out: a query can reach most buckets
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "key long, embedding array<float>")
    index, q = nb.build(v), v.withColumnRenamed("key", "query_key")
    for found, rows in ((nb.within(index, q, 40.0), None), (nb.nearest(index, q, 2), 4000)):
        n, total = shuffled_bytes(found)
        assert rows in (None, n) and total < 10 * vectors.nbytes


def test_small_packs_with_copies_and_repeated_keys(monkeypatch, spark):
    for name, rows in (("PACK_ROWS", 64), ("BLOCK_ROWS", 16), ("LANE_ROWS", 100), ("MOST_PARTS", 5), ("SHARE_BYTES", 4096)):
        monkeypatch.setattr(nb, name, rows)
    vectors = clustered(5, 900, centres=5)
    vectors[200:600] = vectors[200]  # more copies than a pack holds
    keys = [2**53 + (7 * i) % 901 for i in range(len(vectors))]
    v = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, vectors)], "key long, embedding array<float>").repartition(4)
    asked = np.concatenate([vectors[190:215], clustered(6, 30, centres=5), vectors[3:5]])
    names = [*(f"q{i}" for i in range(55)), "q1", "q1"]  # q1 three times
    q = spark.createDataFrame([(k, x.tolist()) for k, x in zip(names, asked)], FIELDS.replace("key", "query_key"))
    scores = np.round(((asked[:, None].astype(np.float64) - vectors[None].astype(np.float64)) ** 2).sum(axis=2), 9)
    index, pool = nb.build(v), {}
    for a, b in np.ndindex(scores.shape):
        pool.setdefault(names[a], []).append((scores[a, b], keys[b]))
    found = nb.nearest(index, q, 7).collect()
    for name, pairs in pool.items():
        assert sorted((r["rank"], r.score, r.key) for r in found if r.query_key == name) == [(i + 1, *p) for i, p in enumerate(sorted(pairs)[:7])]
    close = sorted((r.query_key, r.score, r.key) for r in nb.within(index, q, 0.01).collect())
    assert close == sorted((name, *p) for name, pairs in pool.items() for p in pairs if p[0] <= 0.01)
    assert 0 < nb.compared_share(index, q, 0.0).first().share < 1
