"""Keyed state over streams in many disordered batches, against plain Python."""

import datetime as dt
import random

import pytest
from codeloom.operators import assist
from codeloom.session import shared_dir
from codeloom.streaming import messages as ms
from codeloom.streaming import state as st
from pyspark.sql import functions as F

ORIGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FAR = 10_000_000.0


def at(seconds):
    return ORIGIN + dt.timedelta(seconds=seconds)


def us(seconds):
    return round((at(seconds) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() * 1e6)


def batches_of(spark, parts, schema):
    """A stream that takes one part per batch."""
    folder = shared_dir(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def disordered(rows, when, late, n_parts, seed):
    """Parts in which a row comes at most ``late`` seconds after a later one."""
    draw = random.Random(seed)
    order = sorted(rows, key=lambda r: r[when] + draw.random() * late)
    size = -(-len(order) // n_parts)
    return [order[i : i + size] for i in range(0, len(order), size)]


def plain_connections(events, idle):
    out = []
    for user in {e[0] for e in events}:
        now = None
        for _, t, seq, kind in sorted((e for e in events if e[0] == user), key=lambda e: (e[1], e[2])):
            if now and t - now[1] >= idle:
                out.append((user, us(now[0]), us(now[1] + idle), now[2], now[3], "idle"))
                now = None
            if kind == "connect":
                if now:
                    out.append((user, us(now[0]), us(t), now[2], now[3], "replaced"))
                now = [t, t, 0, 0]
            elif now and kind == "disconnect":
                out.append((user, us(now[0]), us(t), now[2], now[3], "disconnect"))
                now = None
            elif now:
                now[1] = t
                now[2] += kind == "sent"
                now[3] += kind == "received"
        if now:
            out.append((user, us(now[0]), us(now[1] + idle), now[2], now[3], "idle"))
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    draw = random.Random(4)
    kinds = ["connect", "disconnect", "sent", "received", "sent", "ping"]
    return [(draw.randrange(5), draw.randrange(4000) / 4, i, draw.choice(kinds)) for i in range(400)]


@pytest.mark.parametrize("n_parts", [1, 7])
def test_connections_do_not_depend_on_the_batches(spark, events, n_parts):
    parts = [[(u, at(t), s, k) for u, t, s, k in part] for part in disordered(events, 1, 50, n_parts, 9)]
    parts.append([(None, at(3), 1, "connect"), (99, at(FAR), 0, "ping")])
    stream = batches_of(spark, parts, "user_id bigint, ts timestamp, seq bigint, kind string")
    closed = st.connections(stream, F.col("kind"), F.col("seq"), idle_seconds=30)
    found = ms.drain(closed, "connections", conf=st.ROCKSDB).collect()
    assert sorted(map(tuple, found)) == plain_connections(events, 30)
    assert {r.reason for r in found} == {"idle", "replaced", "disconnect"}


def plain_silence(events, width, gone_after):
    out = []
    for user in {e[0] for e in events}:
        counts = {}
        for u, t, ping in events:
            if u == user:
                n, p = counts.get(int(t // width), (0, 0))
                counts[int(t // width)] = (n + 1, p + ping)
        w, silent = None, 0
        for number in range(min(counts), max(counts) + gone_after + 1):
            if number in counts:
                silent = 0
                n, p = counts[number]
                out.append((user, us(number * width), n, p, not p, False, False))
            elif silent < gone_after:
                silent += 1
                out.append((user, us(number * width), 0, 0, True, True, silent == gone_after))
    return sorted(out)


@pytest.mark.parametrize("n_parts, gone_after", [(1, 3), (6, 2)])
def test_silent_windows_are_rows(spark, n_parts, gone_after):
    draw = random.Random(6)
    events = [(draw.randrange(4), draw.choice([0, 900, 3000]) + draw.randrange(300), draw.random() < 0.3) for _ in range(120)]
    parts = [[(u, at(t), p) for u, t, p in part] for part in disordered(events, 1, 50, n_parts, 2)]
    parts.append([(None, at(1), True), (77, at(FAR), True)])
    stream = batches_of(spark, parts, "user_id bigint, ts timestamp, ping boolean")
    found = ms.drain(st.silent_windows(stream, F.col("ping"), gone_after=gone_after), "silence", conf=st.ROCKSDB).collect()
    assert sorted(map(tuple, found)) == plain_silence(events, 30, gone_after)


def test_silence_needs_no_keyed_state(spark):
    """By windows alone: any state store does, and no row passes through Python."""
    events = [(1, 5, True), (1, 70, False), (2, 10, False), (1, 400, True)]
    parts = [[(u, at(t), p) for u, t, p in events], [(77, at(FAR), True)]]
    silence = st.silent_windows(batches_of(spark, parts, "user_id bigint, ts timestamp, ping boolean"), F.col("ping"), gone_after=2)
    found = ms.drain(silence, "silence").collect()
    assert sorted(map(tuple, found)) == plain_silence(events, 30, 2)


@pytest.mark.parametrize("n_parts", [1, 5])
def test_every_reply_is_accounted_for(spark, n_parts):
    draw = random.Random(7)
    asked = [(f"r{i}", draw.choice(["completion_request", "chat_request"]), float(10 * i)) for i in range(60)]
    replies = []
    for i in range(150):
        to, kind, t = draw.choice(asked)
        replies.append((i, draw.choice([to, to, to, "nobody"]), kind.replace("request", "response"), t + draw.choice([0, 1, 5, 9.999, 10, 12, 14.5, 15, 40])))
    schema = {"q": "request_id string, type string, ts timestamp", "r": "reply_id bigint, request_id string, type string, ts timestamp"}
    rows = {"q": [(a, b, at(t)) for a, b, t in asked], "r": [(i, a, b, at(t)) for i, a, b, t in replies]}
    streams = {}
    for name, given, when, end in (("q", asked, 2, ("end", "chat_request", at(FAR))), ("r", replies, 3, (-1, "other", "chat_response", at(FAR)))):
        parts = [[(*x[:-1], at(x[-1])) for x in part] for part in disordered(given, when, 8, n_parts, 3)]
        streams[name] = batches_of(spark, [*parts, [end]], schema[name])
    told = {r.reply_id: r.status for r in ms.drain(ms.account_replies(streams["q"], streams["r"]), "replies").collect()}
    outcomes, unknown = assist.match_replies(*[spark.createDataFrame(rows[n], schema[n]) for n in "qr"])
    settled = {r.reply_id for r in outcomes.filter("reply_id IS NOT NULL").collect()}
    left = {r.reply_id for r in unknown.collect()}
    assert set(told) == settled | left == set(range(150))
    assert {i for i, status in told.items() if status == "settled"} == settled
    limits, sent = {"completion_request": 10, "chat_request": 15}, {a: (b, t) for a, b, t in asked}
    in_time = {i for i, a, _, t in replies if a in sent and sent[a][1] <= t < sent[a][1] + limits[sent[a][0]]}
    assert {i for i, status in told.items() if status == "spare"} == in_time - settled
