import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.operators import assist, metrics
from codeloom.schemas import RUN_RESULT

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_ranked_suggestions(spark):
    df = spark.createDataFrame([(["a", "``` ```", "low", "```python\nb```", "c", "d"], [0.3, 0.9, 0.2, 0.85, 0.5, 0.4])], "s array<string>, c array<double>")
    got = df.select(F.inline(assist.ranked_suggestions(F.col("s"), F.col("c")))).collect()
    assert [tuple(r) for r in got] == [
        ("a", 0.3, "Suggestion (30%)"), ("b", 0.85, "Suggestion (85%)"), ("c", 0.5, "Suggestion (50%)"),
    ]


def test_findings_at_positions(spark):
    findings = spark.createDataFrame(
        [("f", 0, 0, 200, 5, 1, "wide", 0, "m"), ("f", 70, 2, 70, 8, 0, "narrow", 1, "m"), ("g", 0, 0, 0, 9, 0, "other", 2, "m")],
        "file string, start_line int, start_column int, end_line int, end_column int, rule_no int, code string, severity int, message string",
    )
    spots = [("f", 1, 70, 3), ("f", 2, 200, 5), ("f", 3, 200, 6), ("g", 4, 0, 0), ("g", 5, 1, 0), ("f", 6, 130, 0)]
    got = assist.findings_at(spark.createDataFrame(spots, "file string, position_id int, line int, column int"), findings, "file")
    # The finding that starts first comes first.
    assert sorted((r.position_id, r.code, r.label) for r in got.collect()) == [
        (1, "wide", "❌ Error"), (2, "wide", "❌ Error"), (4, "other", "ℹ️ Info"), (6, "wide", "❌ Error"),
    ]


def test_match_replies(spark):
    sent = spark.createDataFrame(
        [("a", "completion_request", at(0)), ("b", "chat_request", at(0)), ("c", "completion_request", at(0)), ("d", "chat_request", at(0))],
        "request_id string, type string, ts timestamp",
    )
    got = spark.createDataFrame(
        [
            (1, "a", "completion_response", at(9.9)), (2, "a", "completion_response", at(3)), (3, "b", "chat_response", at(14)),
            (4, "c", "completion_response", at(10)), (5, "d", "completion_response", at(1)), (6, None, "error", at(1)), (7, "zz", "error", at(1)),
        ],
        "reply_id int, request_id string, type string, ts timestamp",
    )
    outcomes, unknown = assist.match_replies(sent, got)
    assert {r.request_id: (r.reply_id, r.status) for r in outcomes.collect()} == {
        "a": (2, "answered"), "b": (3, "answered"), "c": (None, "timeout"), "d": (5, "rejected"),
    }
    assert sorted(r.reply_id for r in unknown.collect()) == [1, 4, 6, 7]


def test_next_token_metrics(spark):
    logits = [[1.0, 2.0, 0.5], [0.0, 0.0, 3.0], [5.0, 1.0, 1.0]]
    rows = [(1, p, x, y) for p, (x, y) in enumerate(zip(logits, [0, 1, 0]))] + [(2, 0, logits[0], 0), (2, 1, logits[1], -100)]
    got = metrics.next_token_metrics(spark.createDataFrame(rows, "seq_id int, pos int, logits array<double>, label int")).first()

    def loss(x, y):
        return math.log(sum(map(math.exp, x))) - x[y]

    mean = (loss(logits[0], 1) + loss(logits[1], 0)) / 2
    assert got.n_tokens == 2 and got.eval_loss == pytest.approx(mean)
    assert got.perplexity == pytest.approx(math.exp(mean)) and got.accuracy == 0.5
    none = metrics.next_token_metrics(spark.createDataFrame([(1, 0, [1.0], 0)], "seq_id int, pos int, logits array<double>, label int")).first()
    assert (none.n_tokens, none.accuracy) == (0, 0.0)


def test_run_summary(spark):
    rows = [
        ("m", "1", None, "5s", {"epoch": 3.0, "train_loss": 0.5}, {"eval_loss": 0.7, "perplexity": 2.0}, None, True),
        ("m", "0", None, None, None, None, "boom", False),
        ("k", "0", None, None, None, None, None, False),
    ]
    got = {r.model_type: r for r in metrics.run_summary(spark.createDataFrame(rows, RUN_RESULT), F.col("start_time")).collect()}
    assert (got["m"].n_runs, got["m"].n_passed, got["m"].epochs, got["m"].perplexity, got["m"].error) == (2, 1, 3.0, 2.0, None)
    assert (got["k"].n_passed, got["k"].error, got["k"].train_loss) == (0, "Unknown error", None)
