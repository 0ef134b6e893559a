"""Suggestion ranking, positions in findings, message matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import assist as fa
from codeloom.functions import text as tx

# How long a request waits for its reply, in seconds.
TIMEOUTS = {"completion_request": 10, "chat_request": 15}
REPLY_TYPES = {"completion_request": "completion_response", "chat_request": "chat_response"}

MIN_CONFIDENCE, MAX_SHOWN = 0.3, 3
LINES_PER_BUCKET = 64


def ranked_suggestions(suggestions: Column, scores: Column) -> Column:
    """The first three usable suggestions, cleaned, with confidence and title.

    A missing score counts as 0; too little confidence or nothing left after
    cleaning rules a suggestion out.
    """
    def scored(raw: Column, i: Column) -> Column:
        confidence = F.coalesce(F.get(scores, i), F.lit(0.0))
        return F.struct(
            fa.clean_suggestion(raw).alias("text"), confidence.alias("confidence"), fa.percent_title(confidence).alias("title")
        )

    usable = F.filter(
        F.transform(suggestions, scored), lambda s: (s["confidence"] >= MIN_CONFIDENCE) & (s["text"] != "")
    )
    return F.slice(usable, 1, MAX_SHOWN)


def findings_at(positions: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """First finding (by ``rule_no``) whose range holds the position.

    ``positions``: key, position_id, line, column. ``findings``: key,
    start_line, start_column, end_line, end_column, rule_no, code, severity,
    message. Ranges include both ends. Both sides meet on (key, block of lines),
    so that a file with very many findings is spread over its blocks.
    """
    blocks = F.sequence(
        F.floor(F.col("start_line") / LINES_PER_BUCKET), F.floor(F.col("end_line") / LINES_PER_BUCKET)
    )
    spread = findings.withColumn("_block", F.explode(blocks))
    asked = positions.withColumn("_block", F.floor(F.col("line") / LINES_PER_BUCKET))
    at = F.struct("line", "column")
    inside = (at >= F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column"))) & (
        at <= F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column"))
    )
    found = asked.join(spread, [key, "_block"]).filter(inside)
    first = F.min_by(F.struct("code", "severity", "message"), F.struct("start_line", "start_column", "rule_no"))
    return (
        found.groupBy(key, "position_id")
        .agg(first.alias("_f"))
        .select(key, "position_id", "_f.*")
        .withColumn("label", fa.severity_label(F.col("severity")))
    )


def _timeout(kind: Column) -> Column:
    seconds = F.lit(None).cast("int")
    for name, limit in TIMEOUTS.items():
        seconds = F.when(kind == name, limit).otherwise(seconds)
    return seconds


def reply_fits(request_type: Column, reply_type: Column) -> Column:
    fits = F.lit(False)
    for name, reply in REPLY_TYPES.items():
        fits = F.when(request_type == name, reply_type == reply).otherwise(fits)
    return fits


def in_time(request_type: Column, sent: Column, replied: Column) -> Column:
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _timeout(request_type).cast("decimal(18,6)"))
    return (replied >= sent) & (replied < sent + limit)


def outcome(request_type: Column, reply_id: Column, reply_type: Column) -> Column:
    """Status of a request by the reply that settled it, if one did."""
    return F.when(reply_id.isNull(), "timeout").when(reply_fits(request_type, reply_type), "answered").otherwise("rejected")


def match_replies(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their outcome, and replies that no request was waiting for.

    ``requests``: request_id, type, ts. ``replies``: reply_id, request_id, type,
    ts. The earliest reply within the request's time limit settles it: answered
    if its type fits, else rejected; without one the request timed out.
    """
    sent = requests.select("request_id", F.col("type").alias("request_type"), F.col("ts").alias("sent"))
    got = replies.select("reply_id", "request_id", F.col("type").alias("reply_type"), F.col("ts").alias("replied"))
    waited_for = in_time(F.col("request_type"), F.col("sent"), F.col("replied"))
    to_request = (F.col("request_id") == F.col("_to")) & waited_for
    pairs = sent.join(got.withColumnRenamed("request_id", "_to"), to_request, "left")
    first = F.min(F.struct("replied", "reply_id", "reply_type"))
    settled = pairs.groupBy("request_id", "request_type", "sent").agg(first.alias("_r"))
    status = outcome(F.col("request_type"), F.col("_r.reply_id"), F.col("_r.reply_type"))
    outcomes = settled.select("request_id", "request_type", F.col("_r.reply_id").alias("reply_id"), status.alias("status"))
    used = outcomes.filter("reply_id IS NOT NULL").select("request_id", "reply_id")
    return outcomes, got.join(used, ["request_id", "reply_id"], "left_anti")
