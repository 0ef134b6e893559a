import random
import re

import pytest
from codeloom.functions.text import BLANK
from codeloom.operators import packing as pk
from pyspark.sql import functions as F

PLAIN = re.compile(rf"<\|[a-z]+\|>|\w+|[^\w{re.escape(BLANK)}]")


def packed_plainly(rows, length, separator):
    """Windows and pieces of one shard, id by id."""
    stream = []
    for key, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or [])):
        if separator is not None and stream and (stream[-1] is not None):
            stream.append((None, None, separator))
        stream += [(key, i, x) for i, x in enumerate(ids or [])]
    return [stream[i : i + length] for i in range(0, len(stream), length)]


@pytest.mark.parametrize("length, separator", [(16, None), (16, 7), (5, 7), (1, None), (1000, 7)])
def test_packing_keeps_every_id_once(spark, length, separator):
    draw = random.Random(length)
    rows = [(i, [draw.randrange(100) for _ in range(draw.choice([1, 1, 3, 15, 16, 17, 60]))]) for i in range(300)]
    packed = pk.pack_sequences(spark.createDataFrame(rows, "k bigint, input_ids array<int>").repartition(7), "k", length, separator, shards=4).collect()
    shard = {r.k: r.s for r in spark.range(300).select(F.col("id").alias("k"), pk.shard_of(F.col("id"), 4).alias("s")).collect()}
    for s in range(4):
        expected = packed_plainly([r for r in rows if shard[r[0]] == s], length, separator)
        found = sorted((r for r in packed if r.shard == s), key=lambda r: r.window)
        assert [r.window for r in found] == list(range(len(expected)))
        for r, window in zip(found, expected):
            assert r.input_ids == [x for _, _, x in window] and r.n_real == len(window)
            taken = [(p.key, p.start + i, p.at + i) for p in r.pieces for i in range(p.size)]
            assert taken == [(key, i, at) for at, (key, i, _) in enumerate(window) if key is not None]
    assert all(r.n_real == length for r in packed) or len([r for r in packed if r.n_real < length]) <= 4


def test_packing_of_odd_rows(spark):
    rows = [(None, [1, 2]), (None, [1, 2]), (3, []), (4, None), (5, [9] * 40)]
    packed = pk.pack_sequences(spark.createDataFrame(rows, "k bigint, input_ids array<int>"), "k", 8, shards=2)
    assert sorted(x for r in packed.collect() for x in r.input_ids) == sorted([1, 2, 1, 2] + [9] * 40)
    none = spark.createDataFrame([], "k bigint, input_ids array<int>")
    assert pk.pack_sequences(none, "k", 8).collect() == []
    fill = pk.packing_fill(packed, 8).first()
    assert fill.n_ids == 44 and fill.n_windows * 8 == fill.n_ids + fill.n_empty
    assert pk.packing_fill(pk.pack_sequences(none, "k", 8), 8).first().fill is None


def test_packing_across_arrow_batches(spark):
    """A shard that comes in many batches gives the windows it gives in one."""
    rows = [(i, [i] * (i % 9)) for i in range(400)]
    table = spark.createDataFrame(rows, "k bigint, input_ids array<int>")
    whole = pk.pack_sequences(table, "k", 32, 7, shards=3).orderBy("shard", "window").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert pk.pack_sequences(table, "k", 32, 7, shards=3).orderBy("shard", "window").collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


TEXTS = [None, "", " \n\t", "été naïve_1 x<|code|>y", "<|<|a|>|> (b)", "a b\x1cc", "日本語の文章。 ½ x²", "word " * 700, "." * 300, "  lead and trail  "]


@pytest.mark.parametrize("size, overlap", [(256, 50), (4, 1), (3, 0), (1, 0)])
def test_token_chunks_cover_the_text(spark, size, overlap):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, text string")
    for row in pk.chunk_tokens(table, size=size, overlap=overlap).collect():
        text = row.text or ""
        tokens = [m.span() for m in PLAIN.finditer(text)]
        seen = set()
        for i, c in enumerate(row.chunks):
            assert c.first_token == i * (size - overlap) and c.text == text[c.start : c.end]
            assert list(zip(c.starts, c.ends)) == tokens[c.first_token : c.first_token + size]
            assert (c.start, c.end) == (c.starts[0], c.ends[-1])
            seen |= set(range(c.first_token, c.first_token + len(c.starts)))
        assert seen == set(range(len(tokens)))
        assert len(row.chunks) == (0 if not tokens else 1 if len(tokens) <= size else -(-(len(tokens) - size) // (size - overlap)) + 1)


def test_token_chunks_move_no_rows(spark):
    plan = pk.chunk_tokens(spark.range(5).select(F.lit("a b").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        pk.chunk_tokens(spark.range(1).select(F.lit("a").alias("text")), size=5, overlap=5)
