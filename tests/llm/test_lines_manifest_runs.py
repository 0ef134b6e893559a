"""Common lines, the Merkle manifest and periodic runs against plain Python."""

import random

import brute
import pytest
from codeloom.llm import line_dedup, merkle, periodic, queries, rows
from pyspark.sql import functions as F
from test_operators import pairs, same

LEAF = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.fixture(scope="module")
def lined():
    """Shared lines in several spellings, blank lines, lines in one document only, repeated rows, NULL ids."""
    draw = random.Random(5)
    shared = ["Subscribe NOW", "Été À LA plage", "x", " nbsp line", "", "  \t "]
    spelled = lambda line: draw.choice(["", " ", "\t", "\x0b"]) + draw.choice([line, line.upper() if line.isascii() else line]) + draw.choice(["", "\r", " \x0c"])
    out = []
    for i in range(60):
        lines = [spelled(draw.choice(shared)) if draw.random() < 0.5 else f"own {i} {k % 3}" for k in range(draw.randrange(1, 9))]
        out.append((i if i % 11 else None, "\n".join(lines)))
    out += [out[3], out[3], (7, None), (8, ""), (None, "\n\n"), (9, "Subscribe now"), (10, "\n".join(["subscribe now", "own line"] * 3000))]
    return out


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 0), (1, 1)])
def test_common_lines(spark, monkeypatch, lined, min_docs, min_chars):
    docs = spark.createDataFrame(lined, "doc_id bigint, text string").repartition(5)
    for hot in (50_000, 3):  # all keys frequent, and nearly none
        monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
        found, names = line_dedup.without_common_lines(docs, min_docs, min_chars)
        same(found.select("doc_id", *names).collect(), brute.common_lines(lined, min_docs, min_chars))


def test_rare_lines_meet_by_shuffle(spark, monkeypatch, lined):
    docs = spark.createDataFrame(lined, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, names = line_dedup.without_common_lines(docs, 2)
        same(found.select("doc_id", *names).collect(), brute.common_lines(lined, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_common_lines_of_odd_rows(request, which, odd_rows, small_rows):
    docs = request.getfixturevalue(which)
    given = {"odd": pairs(odd_rows), "small": small_rows, "empty": []}[which]
    found, names = line_dedup.without_common_lines(docs, 3)
    assert found.columns == [*docs.columns, *names]
    same(found.select("doc_id", *names).collect(), brute.common_lines(given, 3))


def test_no_python_on_the_way(odd):
    found, _ = line_dedup.without_common_lines(odd, 3)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def tampered(r):
    text = r[4]
    return (*r[:4], text.replace("\n", "")) if text is not None and (r[0] or 0) % 2 == 0 else r


@pytest.mark.parametrize("height", [1, 8])
@pytest.mark.parametrize("sizes", [[], [1], [27, 28, 1, 26], [1] * 30 + [5]])
def test_manifest(spark, height, sizes):
    given = [(1000 * s + i, f"s{s}" if s else None, None if i % 5 == 0 else "en", None if i % 7 == 0 else i, None if i % 4 == 3 else f"text {i}\nénd") for s, n in enumerate(sizes) for i in range(n)]
    given += [(None, "s1", None, None, None), given[0], given[0], ((1 << 60) + 1, None, "fr", 3, "big id")] if len(given) > 50 else []
    table = merkle.leaves(spark.createDataFrame(given, LEAF).repartition(4), F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    found = merkle.manifest(table, height)
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    same(found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect(), brute.merkle(given, tampered))


def test_manifest_of_odd_rows(odd, odd_rows):
    given = [(r[0], r[3], r[2], None, r[1]) for r in odd_rows]
    docs = odd.withColumn("n_chars", F.lit(None).cast("bigint"))
    found = merkle.manifest(merkle.leaves(docs, F.col("text")))
    assert found.filter("NOT verified").isEmpty()
    same(found.select("doc_id", "leaf", "subroot", "root").collect(), [r[:4] for r in brute.merkle(given, lambda r: r)])


def test_runs_of_random_sequences():
    draw = random.Random(1)
    for _ in range(1500):
        n, k = draw.randrange(60), draw.choice([1, 2, 3, 5])
        words = [draw.randrange(k) for _ in range(n)]
        if n > 5 and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + draw.randrange(max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least in (2, 12):
            assert periodic.runs_of(words, least) == brute.runs(words, least)


@pytest.fixture(scope="module")
def repetitive():
    draw = random.Random(8)
    out = [(0, None), (1, ""), (2, " \n "), (None, "a b " * 40), (4, "a " * 11), (4, "a " * 12), (4, "a " * 12)]
    for i in range(300):
        size, letters = draw.randrange(1, 120), draw.choice([2, 4, 30])
        words = [f"w{draw.randrange(letters)}" for _ in range(size)]
        if i % 2:
            a, p = draw.randrange(size), draw.randrange(1, 30)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(size)]
        out.append((10 + i, draw.choice(["", " ", "\n"]) + "  ".join(words) + draw.choice(["", "\t"])))
    period = [f"p{draw.randrange(900)}" for _ in range(700)]
    out.append((900, " ".join((period * 60)[:40_000])))
    return out


def expected_runs(given, least=12):
    out = []
    for doc, text in given:
        words = brute.WORD.findall(text or "")
        found = brute.runs(words, least)
        out.append((doc, found, brute.collapsed(words, found)))
    return out


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_of_texts(spark, repetitive, least):
    given = [r for r in repetitive if r[0] != 900]
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
    found, names = periodic.with_runs(docs, least)
    same([(r[0], [tuple(s) for s in r[1]], r[2]) for r in found.select("doc_id", *names).collect()], expected_runs(given, least))


def test_run_over_a_very_long_text(spark, repetitive):
    found, names = periodic.with_runs(spark.createDataFrame(repetitive[-1:], "doc_id bigint, text string"))
    row = found.first()
    assert [tuple(s) for s in row[names[0]]] == [(0, 40_000, 700)]
    assert row[names[1]].split() == repetitive[-1][1].split()[:700]


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_runs_of_odd_rows(request, which, odd_rows):
    docs = request.getfixturevalue(which)
    found, names = periodic.with_runs(docs)
    assert found.columns == [*docs.columns, *names]
    rows_ = found.select("doc_id", *names).collect()
    expected = [(doc, [], " ".join(brute.WORD.findall(text or ""))) for doc, text in pairs(odd_rows)] if which == "odd" else []
    same([(r[0], [tuple(s) for s in r[1]], r[2]) for r in rows_], expected)


def test_planted_runs(small):
    for r in queries.planted_runs(small).join(small.select("doc_id", F.col("text").alias("old"), (rows.crc_bucket("doc_id", 1 << 32)).alias("h")), "doc_id").collect():
        if r.h % 10 or not r.old:
            assert r.text == r.old
            continue
        words, g = brute.WORD.findall(r.old), r.h // 10
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text.split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
