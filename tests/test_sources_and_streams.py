import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom import jobs
from codeloom.operators.assist import match_replies
from codeloom.session import fits, shared_dir
from codeloom.sources import files, tables
from codeloom.streaming import messages as ms

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_jsonl_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    lines = [
        json.dumps({"id": "1", "content": "é\n", "path": "a.py", "more": [1]}), "{broken", "[1]", json.dumps({"code": "x", "content": ""}),
        json.dumps({"content": 5, "code": "y"}), json.dumps({"content": 0, "code": "z"}), json.dumps({"content": "q", "path": [1]}), "", '"text"',
    ]
    (tmp_path / "deep" / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text("{}")
    good, rejected = files.split_rejects(files.scan_jsonl(spark, str(tmp_path)))
    assert sorted((r.id, r.path, r.content, r.code) for r in good.collect() if r.id) == [("1", "a.py", "é\n", None)]
    assert sorted((r.content or "", r.code or "") for r in good.collect() if not r.id) == [("", ""), ("", ""), ("", "x"), ("", "z")]
    assert sorted(r.rejected for r in rejected.collect()) == ["", '"text"', "[1]", "{broken"]


def test_last_of_a_repeated_key_counts(spark):
    lines = spark.createDataFrame([('{"content": "a", "content": "b", "id": "1"}',)], "value string")
    row = files.parse_records(lines).first()
    assert (row.content, row.id, row.rejected) == ("b", "1", None)
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


@pytest.mark.parametrize("limit", [None, 0, 1, 70, 5000])
def test_lines_are_numbered_however_files_are_split(spark, tmp_path, limit):
    (tmp_path / "b").mkdir()
    for name, n in (("a.jsonl", 400), ("b/c.jsonl", 90), ("e.jsonl", 0)):
        (tmp_path / name).write_text("".join(json.dumps({"id": f"{name}:{i}", "code": "x" * (i % 37)}) + "\n" for i in range(n)))
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.scan_jsonl(spark, str(tmp_path), numbered=True, limit=limit).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert all(r.id.endswith(f":{r.line}") and r.file.endswith(r.id.split(":")[0]) for r in rows)
        assert len(rows) == sum(min(n, n if limit is None else limit) for n in (400, 90))


def test_running_totals_over_ranges(spark, monkeypatch):
    from codeloom.operators import ranking

    rows = [(f"s{i % 50:02}", i, i % 7) for i in range(300)]
    table = spark.createDataFrame(rows, "s string, i int, v int").repartition(5)
    expected, total = {}, 0
    for s, i, v in sorted(rows):
        expected[i], total = total, total + v
    for most in (1000, 0):
        monkeypatch.setattr(ranking, "ONE_TASK", most)
        found = ranking.running_totals(table, ["s", "i"], "v", "before").collect()
        assert {r.i: r.before for r in found} == expected and found[0].asDict().keys() == {"s", "i", "v", "before"}


def test_manifest_has_the_errors(spark, tmp_path):
    good = spark.range(30).selectExpr("id", "concat('t', id) AS text").repartition(4)
    bad = good.selectExpr("id", "CAST(raise_error('cannot be reached') AS string) AS text")
    told = {r.source: r for r in tables.write_sources({"good": good, "bad": bad, "none": good.limit(0), "plain": good.select("id")}, str(tmp_path)).collect()}
    assert (told["good"].n_rows, told["good"].n_chars, told["good"].error) == (30, 80, None)
    assert told["bad"].n_rows is None and "cannot be reached" in told["bad"].error
    assert (told["none"].n_rows, told["plain"].n_rows, told["plain"].n_chars) == (0, 30, None)
    assert spark.read.json(f"{tmp_path}/good").count() == 30


def test_files_that_are_not_read_are_listed(spark, tmp_path, monkeypatch):
    (tmp_path / "long name.py").write_text("x" * 500)
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "skip.bin").write_text("y" * 900)
    (tmp_path / "empty.py").write_text("")
    assert files.rejected_files(spark, str(tmp_path)).collect() == []
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 100)
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_tree(spark, str(tmp_path)).filter("text <> ''").collect()] == ["a.py"]
    gone = files.rejected_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length, r.reason) for r in gone] == [("long name.py", 500, "longer than 100 bytes")]
    assert files.present(spark, [str(tmp_path), f"{tmp_path}/none"]) == ([str(tmp_path)], [f"{tmp_path}/none"])


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    (tmp_path / "junk").mkdir()
    assert not tables.exists(spark, f"{tmp_path}/none") and not tables.exists(spark, f"{tmp_path}/junk")
    (tmp_path / "junk" / "a.parquet").write_text("no table")
    with pytest.raises(Exception, match="a.parquet"):
        tables.exists(spark, f"{tmp_path}/junk")


def test_tree_scan(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a+b.PY").write_bytes(b"x = 1\r\ny\xff = 2\r")
    (tmp_path / "n.md").write_text("# T\n\ufffd ok", encoding="utf-8")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.text) for r in files.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {("a+b.PY", "code", "x = 1\ny = 2\n"), ("n.md", "doc", "# T\n\ufffd ok")}


def test_splits_are_checked(spark):
    path = shared_dir(spark, "splits-test")
    df = spark.createDataFrame([([1], [1], "train"), ([2], [1], "test")], "input_ids array<int>, attention_mask array<int>, split string")
    tables.write_splits(df, path)
    assert {r.split for r in tables.read_splits(spark, path).collect()} == {"train", "test"}
    with pytest.raises(ValueError, match="label"):
        tables.read_splits(spark, path, required=["label"])


def test_jobs(spark, tmp_path):
    raw, tree = tmp_path / "raw", tmp_path / "tree"
    raw.mkdir(), tree.mkdir()
    code = "import os\n\n\ndef f_{0}(x):\n    return x + {0}\n"
    lines = [json.dumps({"code": code.format(i), "path": f"{i}.py"}) for i in range(20)] + ["{broken", json.dumps({"code": "short"})]
    (raw / "a.jsonl").write_text("\n".join(lines))
    built = jobs.build_corpus(spark, str(raw), shared_dir(spark, "job")).collect()
    assert sorted(r.split for r in built) == ["test"] * 2 + ["train"] * 16 + ["validation"] * 2
    assert {r.language for r in built} == {"python"} and sorted(r.text for r in built) == sorted(code.format(i) for i in range(20))
    assert all(len(r.input_ids) == len(r.attention_mask) == r.token_count and not r.truncated for r in built)

    capped = jobs.build_corpus(spark, str(raw), shared_dir(spark, "job"), limit=5).collect()
    assert sorted(r.text for r in capped) == sorted(code.format(i) for i in range(5))
    assert sorted(r.example_id.rsplit(":", 1)[1] for r in capped) == list("01234")

    (tree / "a.py").write_text(code.format(1))
    (tree / "b.md").write_text("# Title\n\nhow to start the server from the command line in a few steps\n")
    with pytest.warns(UserWarning, match="none"):
        index = jobs.build_index(spark, [str(tree), f"{tmp_path}/none"], shared_dir(spark, "job-index"))
    assert sorted((r.metadata.type, r.metadata.name) for r in index.collect()) == [("FunctionDef", "f_1"), ("doc", None)]
    asked = spark.createDataFrame([(1, "start the server", "x = 1")], "query_key int, text string, code string")
    context = jobs.contexts(index, asked, k=1).first().context
    assert context == "# Relevant context from project:\nhow to start the server from the command line in a few steps\n\nx = 1"


def test_fits(spark):
    assert fits(spark.range(3), 3) and not fits(spark.range(4), 3)


def stream_of(spark, df, name):
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_routes(spark):
    raw = [
        '{"type": "completion_request", "request_id": "1"}',
        '{"type": "completion_request", "request_id": "2", "code": "c", "language": "go", "max_suggestions": 1, "cursor_position": 4}',
        '{"type": "chat_request", "request_id": "3", "message": "hi", "code_context": "x"}', '{"type": "ping"}', '{"type": "zap"}', "{}", "nope",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [tuple(r) for r in ms.drain(ms.route(stream_of(spark, df, "raw")), "routes-test").orderBy("i").collect()]
    assert got == [
        (0, "completion", "1", "", "python", 3, None, None, None, None), (1, "completion", "2", "c", "go", 1, 4, None, None, None),
        (2, "chat", "3", None, None, None, None, "hi", "x", None), (3, "pong", None, None, None, None, None, None, None, None),
        (4, "error", None, None, None, None, None, None, None, "Unknown message type: zap"),
        (5, "error", None, None, None, None, None, None, None, "Unknown message type: None"),
        (6, "malformed", None, None, None, None, None, None, None, None),
    ]


def test_routes_of_nulls_and_other_json(spark):
    raw = ['{"type": "completion_request", "code": null, "language": null, "max_suggestions": null}', '{"type": "chat_request", "message": null}', "[1]", "5", "null", '{"type": "ping", "type": "chat_request"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*raw, None])], "i int, raw string")
    got = ms.route(df).orderBy("i").collect()
    assert [r.route for r in got] == ["completion", "chat", "malformed", "malformed", "malformed", "chat", "malformed"]
    assert (got[0].code, got[0].language, got[0].max_suggestions, got[1].message, got[5].message) == (None, None, None, None, "")


EVENTS = [(1, at(0.0), "a"), (1, at(0.1), "b"), (1, at(1.0), "c"), (2, at(0.05), "d"), (9, at(900), "late")]


def test_debounce_batch_and_stream(spark):
    df = spark.createDataFrame(EVENTS, "user_id int, ts timestamp, payload string")
    assert {r.payload for r in ms.debounce(df, "payload").collect()} == {"b", "c", "d", "late"}
    # The last event only moves the watermark; its own pause is not over yet.
    streamed = ms.drain(ms.debounce(stream_of(spark, df, "events"), "payload"), "debounce-test")
    assert {r.payload for r in streamed.collect()} == {"b", "c", "d"}


def test_counters_and_heartbeats(spark):
    rows = [(1, at(0), "ping"), (1, at(10), "in"), (1, at(31), "out"), (2, at(5), "in"), (9, at(900), "in")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, kind string")
    stream = stream_of(spark, df, "beats")
    beats = ms.drain(ms.heartbeats(stream, F.col("kind") == "ping"), "beats-test").collect()
    assert sorted((r.user_id, r.n_messages, r.n_pings, r.idle) for r in beats) == [(1, 1, 0, True), (1, 2, 1, False), (2, 1, 0, True)]
    counted = ms.drain(
        ms.connection_counters(stream, F.col("kind") == "out", F.col("kind") != "out", window="1 minute", late="1 second"), "counters-test"
    ).collect()
    assert sorted((r.user_id, r.messages_sent, r.messages_received) for r in counted) == [(1, 1, 2), (2, 0, 1)]


def test_request_timeout_stream(spark):
    sent = [("a", "completion_request", at(5)), ("b", "chat_request", at(0)), ("c", "completion_request", at(0)), ("d", "chat_request", at(0)), ("z", "chat_request", at(900))]
    got = [
        (1, "a", "completion_response", at(1)), (2, "a", "completion_response", at(8)), (3, "b", "error", at(12)), (4, "b", "chat_response", at(9)),
        (5, "c", "completion_response", at(12)), (6, "d", "error", at(3)), (7, "d", "chat_response", at(4)), (8, "x", "error", at(900)),
    ]
    sent = spark.createDataFrame(sent, "request_id string, type string, ts timestamp")
    got = spark.createDataFrame(got, "reply_id int, request_id string, type string, ts timestamp")
    expected = {"a": (2, "answered"), "b": (4, "answered"), "c": (None, "timeout"), "d": (6, "rejected")}
    in_batch = {r.request_id: (r.reply_id, r.status) for r in match_replies(sent, got)[0].collect()}
    assert in_batch == expected | {"z": (None, "timeout")}
    assert {r.request_id: (r.reply_id, r.status) for r in ms.match_in_time(sent, got).collect()} == in_batch
    rows = ms.drain(ms.match_in_time(stream_of(spark, sent, "sent"), stream_of(spark, got, "got")), "timeout-test").collect()
    assert {r.request_id: (r.reply_id, r.status) for r in rows} == expected


def test_drain_to_the_end(spark):
    path = shared_dir(spark, "ended")
    df = spark.createDataFrame(EVENTS, "user_id int, ts timestamp, payload string")
    df.write.parquet(path)
    last = spark.createDataFrame([(None, datetime(9999, 1, 1), None)], df.schema)
    stream = ms.debounce(spark.readStream.schema(df.schema).parquet(path), "payload")
    rows = ms.drain(stream, "ended-test", lambda: last.write.mode("append").parquet(path)).collect()
    assert sorted(r.payload for r in rows) == ["b", "c", "d", "late"]


def test_reconnect_delays(spark):
    got = spark.range(7).select(ms.reconnect_delay_ms(F.col("id")).alias("d")).collect()
    assert [r.d for r in got] == [1000, 2000, 4000, 8000, 16000, None, None]
