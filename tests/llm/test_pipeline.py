from collections import Counter

import corpus_pipeline
from codeloom.llm import mixture
from pyspark.sql import functions as F


def test_stages_follow_each_other(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns, name
        if name != "mixture":
            assert 0.5 * n < after.count() <= docs.count(), name
        docs = after
    words = docs.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(found) == docs.count() and words > 0
    ordered = found.sort_values("start")
    assert ordered["doc_id"].is_monotonic_increasing
    assert (ordered["start"].to_numpy()[1:] == ordered["n_tokens"].cumsum().to_numpy()[:-1]).all()


def test_stages_take_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_rows_without_id_are_mixed_like_others(spark):
    rows = [(i if i % 3 else None, " ".join(["word"] * (3 + i % 5) + [str(i)]), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    found = Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs, "").collect()))
    assert found == {tuple(r.row): r.times for r in mixture.drawn(docs, docs.columns).collect() if r.times}
    total = sum(len(text.split()) for _, text, _ in rows)
    for source, share in (("a", 1 / 3), ("b", 2 / 3)):
        words = sum(n * len(text.split()) for (_, text, s), n in found.items() if s == source)
        assert abs(words - share * total) <= 4


def test_texts_stay_where_no_language_is_given(spark, odd):
    docs = spark.createDataFrame([(1, "some words", None), (2, "слова", None), (3, "12 ..", None), (4, None, None), (None, "x", None)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["some words", "x", "слова"]
    named = corpus_pipeline.identify_language(spark, odd, "").collect()
    assert sorted(map(str, named)) == sorted(str(r) for r in odd.collect() if any(c.isalpha() for c in r.text or ""))
