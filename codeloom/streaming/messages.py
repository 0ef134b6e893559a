"""Structured Streaming jobs over message streams.

Every function takes and gives a DataFrame; the window and join jobs work on a
batch as well as on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators.assist import in_time, outcome
from codeloom.schemas import COMPLETION_REQUEST
from codeloom.session import shared_dir
from codeloom.sources import tables

# Defaults of a completion request, reconnect and liveness times.
DEFAULT_LANGUAGE, DEFAULT_SUGGESTIONS = "python", 3
RECONNECT_BASE_MS, RECONNECT_MAX_MS, RECONNECT_ATTEMPTS = 1000, 30000, 5
PING_SECONDS = 30
DEBOUNCE = "150 milliseconds"


def drain(stream: DataFrame, purpose: str, end: Callable[[], None] | None = None, conf: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """Runs a stream over what its source holds now, and gives the table it wrote.

    What the watermark has not passed stays in the state. ``end`` adds a row of a far
    later time to the source, after which the stream goes on from its checkpoint
    and gives out the rest; that row itself stays behind. ``conf`` is set while the stream runs.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark, purpose)
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        for add in (None,) if end is None else (None, end):
            if add is not None:
                add()
            run = (
                stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
                .option("path", f"{folder}/rows").trigger(availableNow=True).start()
            )
            run.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_batches(stream: DataFrame, purpose: str, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what its source holds now, handing each batch to ``each``."""
    folder = shared_dir(stream.sparkSession, purpose)
    run = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    run.awaitTermination()


def route(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Parses JSON messages and tells each where to go, with defaults filled in.

    Routes: completion, chat, pong, error (unknown type), malformed (no JSON object). A default
    stands for a key that is absent; a key that is ``null`` stays NULL.
    """
    with tx.last_key_counts(messages.sparkSession):
        parsed = tx.pinned(messages, _m=F.from_json(raw, COMPLETION_REQUEST), _v=F.try_parse_json(raw))
    parsed = tx.pinned(parsed, _ok=F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    kind = F.col("_m.type")
    to = (
        F.when(~F.coalesce("_ok", F.lit(False)), "malformed")
        .when(kind == "completion_request", "completion")
        .when(kind == "chat_request", "chat")
        .when(kind == "ping", "pong")
        .otherwise("error")
    )
    completion = to == "completion"
    keep = [name for name in messages.columns if name != raw]

    def given(name: str, default: str | int) -> Column:
        absent = F.try_variant_get("_v", f"$.{name}", "variant").isNull()
        return F.when(absent, F.lit(default)).otherwise(F.col(f"_m.{name}"))

    return parsed.select(
        *keep,
        to.alias("route"),
        F.col("_m.request_id").alias("request_id"),
        F.when(completion, given("code", "")).alias("code"),
        F.when(completion, given("language", DEFAULT_LANGUAGE)).otherwise(F.col("_m.language")).alias("language"),
        F.when(completion, given("max_suggestions", DEFAULT_SUGGESTIONS)).alias("max_suggestions"),
        F.when(completion, F.col("_m.cursor_position")).alias("cursor_position"),
        F.when(to == "chat", given("message", "")).alias("message"),
        F.when(to == "chat", F.col("_m.code_context")).alias("code_context"),
        F.when(to == "error", F.concat(F.lit("Unknown message type: "), F.coalesce(kind, F.lit("None")))).alias("error"),
    )


def connection_counters(messages: DataFrame, sent: Column, received: Column, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Messages sent and received per user and window, with first and last time."""
    return (
        messages.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", window).alias("w"))
        .agg(
            F.count_if(sent).alias("messages_sent"),
            F.count_if(received).alias("messages_received"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select("user_id", F.col("w.start").alias("window_start"), "messages_sent", "messages_received", "first_ts", "last_ts")
    )


def connection_lifetimes(messages: DataFrame, sent: Column, received: Column, idle: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """One row per connection once it has been idle for ``idle``: duration and counters."""
    return (
        messages.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", idle).alias("w"))
        .agg(
            F.min("ts").alias("connected_at"),
            F.max("ts").alias("last_ts"),
            F.count_if(sent).alias("messages_sent"),
            F.count_if(received).alias("messages_received"),
        )
        .withColumn("seconds", F.unix_micros("last_ts") / 1e6 - F.unix_micros("connected_at") / 1e6)
        .select("user_id", "connected_at", "seconds", "messages_sent", "messages_received")
    )


def debounce(events: DataFrame, payload: str, quiet: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """The last event of every run of events without a pause of ``quiet``."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", quiet).alias("w"))
        .agg(
            F.max_by(F.col(payload), F.struct("ts", payload)).alias(payload),
            F.max("ts").alias("ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .select("user_id", payload, "ts", "n_events")
    )


def match_in_time(requests: DataFrame, replies: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Requests with their outcome, once their time limit has passed.

    The earliest reply within the request's time limit settles it, as in
    ``match_replies``: answered if its type fits, else rejected; without one the
    request timed out. The time bound on both sides lets Spark drop the state of
    settled and of expired requests.
    """
    sent = requests.select("request_id", F.col("type").alias("request_type"), F.col("ts").alias("sent")).withWatermark("sent", late)
    got = replies.select(
        F.col("request_id").alias("reply_to"), "reply_id", F.col("type").alias("reply_type"), F.col("ts").alias("replied")
    ).withWatermark("replied", late)
    longest = F.expr("INTERVAL 15 SECONDS")
    bounded = (F.col("replied") >= F.col("sent")) & (F.col("replied") <= F.col("sent") + longest)
    matches = (F.col("request_id") == F.col("reply_to")) & bounded & in_time(F.col("request_type"), F.col("sent"), F.col("replied"))
    first = F.min(F.when(F.col("replied").isNotNull(), F.struct("replied", "reply_id", "reply_type")))
    settled = sent.join(got, matches, "left_outer").groupBy("request_id", "request_type", "sent").agg(first.alias("_r"))
    return settled.select(
        "request_id", "request_type", "sent", "_r.reply_id", "_r.reply_type",
        outcome(F.col("request_type"), F.col("_r.reply_id"), F.col("_r.reply_type")).alias("status"),
    )


def account_replies(requests: DataFrame, replies: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Every reply with what became of it: (reply_id, reply_to, reply_type, status), once that is certain.

    ``settled``: the earliest reply in its request's time. ``spare``: also in time, but not the earliest.
    ``unasked``: no request waited for it, as there was none, or its time was over. Replies are joined to
    requests twice, both times with bounds on both sides, so that no state is held for longer than the longest
    time limit: from the requests' side to order the replies of one request, and from the replies' side to find
    those that meet none.
    """
    longest = F.expr("INTERVAL 15 SECONDS")

    def sides() -> tuple[DataFrame, DataFrame, Column]:
        sent = requests.select("request_id", F.col("type").alias("request_type"), F.col("ts").alias("sent")).withWatermark("sent", late)
        got = replies.select(F.col("request_id").alias("reply_to"), "reply_id", F.col("type").alias("reply_type"), F.col("ts").alias("replied")).withWatermark("replied", late)
        bounded = (F.col("replied") >= F.col("sent")) & (F.col("replied") <= F.col("sent") + longest)
        return sent, got, (F.col("request_id") == F.col("reply_to")) & bounded & in_time(F.col("request_type"), F.col("sent"), F.col("replied"))

    sent, got, matches = sides()
    waited = F.sort_array(F.collect_list(F.struct("replied", "reply_id", "reply_type")))
    asked = sent.join(got, matches).groupBy("request_id", "request_type", "sent").agg(waited.alias("_r"))
    asked = asked.select("request_id", F.posexplode("_r").alias("_place", "_one"))
    status = F.when(F.col("_place") == 0, "settled").otherwise("spare")
    asked = asked.select("_one.reply_id", F.col("request_id").alias("reply_to"), "_one.reply_type", status.alias("status"))

    sent, got, matches = sides()
    stray = got.join(sent, matches, "left_outer").filter("request_id IS NULL")
    return asked.unionByName(stray.select("reply_id", "reply_to", "reply_type", F.lit("unasked").alias("status")))


def heartbeats(messages: DataFrame, ping: Column, seconds: int = PING_SECONDS, late: str = "1 minute") -> DataFrame:
    """Messages and pings per user and ping interval; no ping means idle."""
    return (
        messages.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(ping).alias("n_pings"))
        .select("user_id", F.col("w.start").alias("window_start"), "n_messages", "n_pings", (F.col("n_pings") == 0).alias("idle"))
    )


def reconnect_delay_ms(attempt: Column) -> Column:
    """Wait before reconnect ``attempt`` (0-based); NULL when attempts are used up."""
    delay = F.least(F.lit(RECONNECT_BASE_MS) * F.pow(F.lit(2), attempt), F.lit(RECONNECT_MAX_MS))
    return F.when(attempt < RECONNECT_ATTEMPTS, delay.cast("bigint"))


def stream_index(
    stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], path: str, name: str
) -> DataFrame:
    """Chunks arriving texts, and embeds and adds the chunks the index lacks.

    Every batch is a part of the index under the stream's name and the batch's
    number, so a batch that is replayed after a failure replaces itself.
    """
    spark: SparkSession = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        tables.grow_index(spark, to_chunks(batch), embed, path, f"{name}-{number}")

    drain_batches(stream, "index-stream", append)
    return tables.read_index(spark, path)
