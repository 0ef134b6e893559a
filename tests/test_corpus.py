import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import corpus, ranking
from codeloom.operators import tokens as tk

FIBONACCI = 'def fib(n):\n    """Doc."""\n    if n < 2:\n        return n\n    return fib(n - 1) + fib(n - 2)\n'


def test_quality_metrics(spark):
    rows = [
        ("ok", FIBONACCI),
        ("broken", "class TodoApp {\n  constructor() {}\n}\n\n"),
        ("other", "const a = 1;\n// note\nconst b = 2;\n\n"),
    ]
    df = corpus.with_quality(spark.createDataFrame(rows, "id string, text string"))
    got = {r.id: r for r in df.collect()}
    assert (got["ok"].valid_syntax, got["ok"].points) == (True, 5)
    assert (got["broken"].valid_syntax, got["broken"].points) == (False, 2)
    assert (got["other"].valid_syntax, got["other"].points) == (None, 2)
    assert got["ok"].line_count == 6 and got["ok"].avg_line_length == len(FIBONACCI) / 6


def test_filter_parses_only_what_the_parse_can_save(spark):
    rows = [
        (1, "python", FIBONACCI),
        # One flag only; valid Python lifts it to three points.
        (2, "python", "class A:\n  pass\n\n\n\n"),
        # One flag only and no Python.
        (3, "unknown", "the class of\nplain\nwords\n\n\n"),
        (4, "javascript", "import x;\nfoo(1);\n\n\n\n"),
        (5, "unknown", "import x;\nfoo(1);\n\n\n\n"),
        (6, "python", "import os\n"),
    ]
    df = spark.createDataFrame(rows, "id int, language string, text string")
    assert sorted(r.id for r in corpus.filter_code(df).collect()) == [1, 2, 5]
    # The same answer as scoring every file in full.
    full = corpus.with_quality(df).filter(F.col("quality_score") >= 0.3)
    assert sorted(r.id for r in full.collect()) == sorted(r.id for r in corpus.filter_quality(df).collect())


def test_caps_with_a_hot_group(spark):
    random.seed(1)
    rows = [(i, "hot" if random.random() < 0.6 else f"g{i % 5}") for i in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, g string").repartition(16)
    got = sorted((r.g, r.id, r.rank) for r in ranking.first_n(df, ["g"], [F.col("id")], 7).collect())
    want = []
    for g in {r[1] for r in rows}:
        want += [(g, i, n + 1) for n, i in enumerate(sorted(i for i, x in rows if x == g)[:7])]
    assert got == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 17, 1003])
def test_ratio_split_is_exact(spark, n):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.split for r in ranking.ratio_split(df, "doc_id").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    train, validation = int(n * 0.8), int(n * 0.1)
    want = {i: "train" if p < train else "validation" if p < train + validation else "test" for p, i in enumerate(order)}
    assert got == want


def test_dense_ids(spark):
    random.seed(2)
    counts = [(f"t{i}", random.choice([1, 1, 1, 2, 5, 9])) for i in range(500)]
    got = ranking.dense_ids(spark.createDataFrame(counts, "token string, n long"), "token", "n", "token_id").collect()
    order = sorted(counts, key=lambda c: (-c[1], hashlib.md5(c[0].encode()).hexdigest(), c[0]))
    assert {r.token: r.token_id for r in got} == {t: i for i, (t, _) in enumerate(order)}


def test_limit_counts_rejected_lines_and_cuts_over_all(spark):
    rows = [("a", i, i % 2 == 0) for i in range(10)] + [("b", i, True) for i in range(10)]
    df = spark.createDataFrame(rows, "source string, line int, good boolean")
    got = corpus.limited_per_source(df, "source", "line", 6, F.col("good")).collect()
    assert sorted((r.source, r.line) for r in got) == [("a", 0), ("a", 2), ("a", 4), ("b", 0), ("b", 1), ("b", 2)]


def test_oversample_and_union(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    got = corpus.oversample(df, F.col("id")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 60, "validation": 3}
    both = corpus.union_sources(df, spark.createDataFrame([(1, "x")], "id int, extra string"))
    assert both.count() == 6 and both.columns == ["id", "extra"]


def test_tokens_ids_and_padding(spark):
    texts = [(1, "a b a, été"), (2, "a " * 600), (3, None), (4, "zz <|class|> rare")]
    df = spark.createDataFrame(texts, "id int, text string")
    words = tk.build_vocabulary(df)
    ids = {r.token: r.token_id for r in words.collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and ids["a"] == 0
    # Specials come last, in list order; the one the texts hold already keeps its id.
    missing = [t for t in dict.fromkeys(tk.SPECIAL_TOKENS + tk.CODE_TOKENS) if t != "<|class|>"]
    assert [ids[t] for t in missing] == list(range(len(ids) - len(missing), len(ids)))

    partial = words.filter("token <> 'rare'")
    got = {r.id: r for r in tk.encode(df, partial, "id", max_length=16).collect()}
    start, end, unk = ids[tk.START], ids[tk.END], ids[tk.UNK]
    assert got[1].input_ids == [start, 0, ids["b"], 0, ids[","], ids["été"], end]
    assert got[2].truncated and got[2].token_count == 16 and got[2].input_ids == [start] + [0] * 15
    assert got[3].input_ids == [start, end] and not got[3].truncated
    assert got[4].input_ids == [start, ids["zz"], ids["<|class|>"], unk, end]
    padded = {r.id: r for r in tk.pad(tk.encode(df, words, "id", max_length=16), F.lit(ids[tk.PAD]), "id", 16).collect()}
    for row in padded.values():
        assert len(row.input_ids) == len(row.attention_mask) == 16
    assert padded[3].input_ids == [start, end] + [ids[tk.PAD]] * 14 and padded[3].attention_mask == [1, 1] + [0] * 14


def test_rare_tokens_take_the_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i} common") for i in range(60)], "id int, text string")
    words = tk.build_vocabulary(df)
    whole = {r.id: r.input_ids for r in tk.encode(df, words, "id").collect()}
    monkeypatch.setattr(tk, "HOT_TOKENS", 2)
    assert {r.id: r.input_ids for r in tk.encode(df, words, "id").collect()} == whole


def test_plans(spark):
    """No Python before the cheap conditions; no window over unbounded rows in one task."""
    files = spark.createDataFrame([("a.py", FIBONACCI)], "path string, text string")
    plan = corpus.filter_code(corpus.with_language(files))._jdf.queryExecution().executedPlan().toString()
    python = plan.index("ArrowEvalPython")
    assert plan.index("length(text", python) > python
    split = ranking.ratio_split(spark.range(10), "id")
    assert "Exchange" not in split._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]


@pytest.mark.parametrize("hot", [3, 500_000])
def test_tokens_are_looked_up_where_the_texts_lie(spark, monkeypatch, hot):
    monkeypatch.setattr(tk, "HOT_TOKENS", hot)
    texts = [(1, "a b c d a"), (2, None), (3, "e e f zz"), (None, "a g")]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("more", F.col("id") * 10).repartition(3)
    words = tk.build_vocabulary(df.filter("text NOT LIKE '%zz%' OR text IS NULL")).localCheckpoint()
    ids = {r.token: r.token_id for r in words.collect()}
    coded = tk.encode(df, words, "id", keep=("more",))
    got = {r.id: (r.input_ids, r.more) for r in coded.collect()}
    for key, text in texts:
        told = [tk.START, *(text or "").split(), tk.END]
        assert got[key] == ([ids.get(t, ids[tk.UNK]) for t in told], key and key * 10)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert hot == 3 or ("MapInArrow" in plan and "explode(" not in plan and "HashAggregate" not in plan)
    # A key that comes twice is one row, tokens place by place.
    twice = spark.createDataFrame([(7, "a b"), (7, "a b"), (8, "a")], "id long, text string")
    a, b, start, end = (ids[t] for t in ("a", "b", tk.START, tk.END))
    got = {r.id: r.input_ids for r in tk.encode(twice, words, "id").collect()}
    assert got == {7: [start, start, a, a, b, b, end, end], 8: [start, a, end]}
