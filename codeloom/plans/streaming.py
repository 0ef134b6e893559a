"""Streaming queries: file streams over the event and document tables.

The checks state the same rows in batch form, all of them: after the table, a row of
a far later time lets the watermark pass what is still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import retrieval as rt
from codeloom.operators import segments as sg
from codeloom.plans.assist import MATCH_CTE
from codeloom.plans.registry import query
from codeloom.plans.retrieval import DIMS, keyed_chunks
from codeloom.plans.segments import windows_sql
from codeloom.plans.views import K_SQL, as_instants, as_replies, as_requests
from codeloom.schemas import DOCUMENT, EVENT
from codeloom.session import shared_dir
from codeloom.streaming import messages as ms
from codeloom.streaming import state as st


def file_stream(spark, sf_dir, name, schema) -> DataFrame:
    """A table as a stream of files; the pattern admits one file as well as a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def event_stream(spark, sf_dir) -> DataFrame:
    return as_instants(file_stream(spark, sf_dir, "events", EVENT))


def events_with_end(spark, sf_dir) -> tuple[Callable[[], DataFrame], Callable[[], None]]:
    """The event table as a stream that can be ended: gives what makes the stream, and what adds the last row."""
    folder = shared_dir(spark, "end")
    # Its keys are not NULL: joins leave rows without key out before their time is seen.
    values = {"event_id": -1, "user_id": -1, "ts": "9999-01-01 00:00:00", "event_type": "error", "props": '{"k": 1}'}
    columns = spark.createDataFrame([], EVENT).schema
    last = spark.range(1).select(*[F.lit(values.get(field.name)).cast(field.dataType).alias(field.name) for field in columns])
    last.limit(0).write.parquet(folder)

    def stream() -> DataFrame:
        ending = spark.readStream.schema(EVENT).parquet(folder)
        return as_instants(file_stream(spark, sf_dir, "events", EVENT).union(ending))

    return stream, lambda: last.write.mode("append").parquet(folder)


def micros(ts: str):
    return F.unix_micros(ts)


# One JSON message per event: some fields left out, unknown types, broken lines.
MESSAGE = """CASE event_type
  WHEN 'view' THEN concat('{"type": "completion_request", "request_id": "r', event_id, '", "code": "c', k, '"',
    CASE WHEN k % 2 = 0 THEN ', "language": "java"' ELSE '' END, CASE WHEN k % 3 = 0 THEN ', "max_suggestions": 5' ELSE '' END, '}')
  WHEN 'click' THEN concat('{"type": "chat_request", "request_id": "r', event_id, '", "message": "m', k, '"}')
  WHEN 'signup' THEN concat('{"type": "ping", "request_id": "r', event_id, '"}')
  WHEN 'purchase' THEN concat('{"type": "buy", "request_id": "r', event_id, '"}')
  ELSE concat('{"type": "ping", ', k) END"""


@query(
    f"""WITH e AS (SELECT event_id, event_type AS t, {K_SQL} AS k FROM events)
      SELECT event_id, CASE t WHEN 'view' THEN 'completion' WHEN 'click' THEN 'chat' WHEN 'signup' THEN 'pong' WHEN 'purchase' THEN 'error' ELSE 'malformed' END AS route,
        CASE WHEN t <> 'error' THEN concat('r', event_id) END AS request_id, CASE WHEN t = 'view' THEN concat('c', k) END AS code,
        CASE WHEN t = 'view' THEN CASE WHEN k % 2 = 0 THEN 'java' ELSE 'python' END END AS language,
        CASE WHEN t = 'view' THEN CASE WHEN k % 3 = 0 THEN 5 ELSE 3 END END AS max_suggestions,
        CASE WHEN t = 'click' THEN concat('m', k) END AS message, CASE WHEN t = 'purchase' THEN 'Unknown message type: buy' END AS error FROM e"""
)
def stream_route_messages(spark, sf_dir):
    events = event_stream(spark, sf_dir).withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS int)"))
    routed = ms.route(events.select("event_id", F.expr(MESSAGE).alias("raw")))
    return ms.drain(routed, "routes").select(
        "event_id", "route", F.when(F.col("route") != "malformed", F.col("request_id")).alias("request_id"),
        "code", "language", "max_suggestions", "message", "error",
    )


@query(
    """SELECT user_id, epoch_us(w) AS window_start, messages_sent, messages_received, epoch_us(a) AS first_at, epoch_us(z) AS last_at FROM (
        SELECT user_id, date_trunc('day', ts)::timestamp AS w, count(*) FILTER (event_type IN ('view', 'purchase')) AS messages_sent,
          count(*) FILTER (event_type IN ('click', 'signup')) AS messages_received, min(ts) AS a, max(ts) AS z FROM events GROUP BY ALL)"""
)
def stream_connection_stats(spark, sf_dir):
    stream, end = events_with_end(spark, sf_dir)
    kind = F.col("event_type")
    counted = ms.connection_counters(stream(), kind.isin("view", "purchase"), kind.isin("click", "signup"))
    return ms.drain(counted, "counters", end).select(
        "user_id", micros("window_start").alias("window_start"), "messages_sent", "messages_received",
        micros("first_ts").alias("first_at"), micros("last_ts").alias("last_at"),
    )


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
      runs AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked)
      SELECT user_id, event_id, last_at, n_events FROM (
        SELECT user_id, arg_max(event_id, ts) AS event_id, epoch_us(max(ts)) AS last_at, count(*) AS n_events FROM runs GROUP BY user_id, run)"""
)
def stream_debounce(spark, sf_dir):
    """A pause of six hours, as the table's events lie minutes apart."""
    stream, end = events_with_end(spark, sf_dir)
    last = ms.debounce(stream(), "event_id", quiet="6 hours")
    return ms.drain(last, "debounce", end).select("user_id", "event_id", micros("ts").alias("last_at"), "n_events")


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
      runs AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked)
      SELECT user_id, epoch_us(a) AS connected_at, round(epoch_us(z) / 1e6 - epoch_us(a) / 1e6, 3) AS seconds, messages_sent, messages_received FROM (
        SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) FILTER (event_type IN ('view', 'purchase')) AS messages_sent,
          count(*) FILTER (event_type IN ('click', 'signup')) AS messages_received FROM runs GROUP BY user_id, run)"""
)
def stream_connection_lifetimes(spark, sf_dir):
    """A user's events less than six hours apart as one connection."""
    stream, end = events_with_end(spark, sf_dir)
    kind = F.col("event_type")
    lived = ms.connection_lifetimes(
        stream(), kind.isin("view", "purchase"), kind.isin("click", "signup"), idle="6 hours"
    )
    return ms.drain(lived, "lifetimes", end).select(
        "user_id", micros("connected_at").alias("connected_at"), F.round("seconds", 3).alias("seconds"), "messages_sent", "messages_received"
    )


@query(
    f"""{MATCH_CTE} SELECT req.request_id, type AS request_type, reply_id, reply_type,
        CASE WHEN reply_id IS NULL THEN 'timeout' WHEN reply_type = replace(type, 'request', 'response') THEN 'answered' ELSE 'rejected' END AS status
      FROM req LEFT JOIN settled ON req.request_id = settled.request_id"""
)
def stream_request_timeout(spark, sf_dir):
    stream, end = events_with_end(spark, sf_dir)
    matched = ms.match_in_time(as_requests(stream()), as_replies(stream()))
    return ms.drain(matched, "timeouts", end).select("request_id", "request_type", "reply_id", "reply_type", "status")


@query(
    """SELECT user_id, epoch_us(w) AS window_start, n_messages, n_pings, n_pings = 0 AS idle FROM (
        SELECT user_id, time_bucket(INTERVAL 30 SECOND, ts) AS w, count(*) AS n_messages, count(*) FILTER (event_type = 'signup') AS n_pings FROM events GROUP BY ALL)"""
)
def heartbeat_windows(spark, sf_dir):
    stream, end = events_with_end(spark, sf_dir)
    beats = ms.heartbeats(stream(), F.col("event_type") == "signup")
    return ms.drain(beats, "heartbeats", end).select("user_id", micros("window_start").alias("window_start"), "n_messages", "n_pings", "idle")


EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' WHEN 'click' THEN 'received' ELSE 'sent' END"


@query(
    f"""WITH e AS (SELECT user_id, ts, event_id, {EVENT_KIND} AS kind FROM events),
      part AS (SELECT *, count(*) FILTER (kind = 'connect') OVER w AS seg, lag(ts) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      marked AS (SELECT *, row_number() OVER w AS rn, kind <> 'connect' AND ts - before >= INTERVAL 6 HOUR AS idled, kind = 'disconnect' AS left_off FROM part WHERE seg > 0
        WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts, event_id)),
      stopped AS (SELECT *, coalesce(min(rn) FILTER (idled OR left_off) OVER (PARTITION BY user_id, seg), 9223372036854775807) AS stop FROM marked),
      summed AS (SELECT user_id, seg, min(ts) AS since, max(ts) FILTER (rn < stop) AS last, count(*) FILTER (rn < stop AND kind = 'sent') AS messages_sent,
        count(*) FILTER (rn < stop AND kind = 'received') AS messages_received, bool_or(rn = stop AND left_off AND NOT idled) AS ended, max(ts) FILTER (rn = stop) AS stop_at, bool_or(rn = stop) AS stops
        FROM stopped GROUP BY user_id, seg),
      closed AS (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY seg) AS following FROM summed)
      SELECT user_id, epoch_us(since) AS connected_at,
        epoch_us(CASE WHEN ended THEN stop_at WHEN NOT stops AND following - last < INTERVAL 6 HOUR THEN following ELSE last + INTERVAL 6 HOUR END) AS closed_at, messages_sent, messages_received,
        CASE WHEN ended THEN 'disconnect' WHEN NOT stops AND following - last < INTERVAL 6 HOUR THEN 'replaced' ELSE 'idle' END AS reason FROM closed"""
)
def stream_connections(spark, sf_dir):
    """Connections that a signup opens and an error ends; given up after six hours, as events lie minutes apart."""
    stream, end = events_with_end(spark, sf_dir)
    kept = st.connections(stream(), F.expr(EVENT_KIND), F.col("event_id"), idle_seconds=6 * 3600)
    return ms.drain(kept, "connections", end, st.ROCKSDB)


@query(
    """WITH seen AS (SELECT user_id, epoch_us(ts) // 30000000 AS w, count(*) AS n, count(*) FILTER (event_type = 'signup') AS p FROM events GROUP BY ALL),
      following AS (SELECT *, least(3, coalesce(lead(w) OVER (PARTITION BY user_id ORDER BY w) - w - 1, 3)) AS gap FROM seen),
      silence AS (SELECT user_id, w, unnest(range(1, gap + 1)) AS k FROM following)
      SELECT user_id, w * 30000000 AS window_start, n AS n_messages, p AS n_pings, p = 0 AS idle, false AS silent, false AS gone FROM seen
      UNION ALL SELECT user_id, (w + k) * 30000000, 0, 0, true, true, k = 3 FROM silence"""
)
def silent_windows(spark, sf_dir):
    """Ping intervals of every user, those in which nothing came too, until the user counts as gone."""
    stream, end = events_with_end(spark, sf_dir)
    return ms.drain(st.silent_windows(stream(), F.col("event_type") == "signup"), "silence", end, st.ROCKSDB)


@query(
    f"""{MATCH_CTE} SELECT reply_id, request_id AS reply_to, type AS reply_type,
        CASE WHEN reply_id IN (SELECT reply_id FROM settled) THEN 'settled' WHEN reply_id IN (SELECT reply_id FROM pairs) THEN 'spare' ELSE 'unasked' END AS status FROM rep"""
)
def stream_reply_accounts(spark, sf_dir):
    stream, end = events_with_end(spark, sf_dir)
    told = ms.account_replies(as_requests(stream()), as_replies(stream()))
    return ms.drain(told, "replies", end)


@query(f"SELECT concat(doc_id, ':', s) AS key, length(t) AS n_chars, {DIMS} AS dims FROM ({windows_sql('documents')})")
def stream_index_append(spark, sf_dir):
    """Documents arrive as a stream, twice; the index holds every chunk once."""
    path = shared_dir(spark, "grown")

    def to_chunks(batch: DataFrame) -> DataFrame:
        pieces = batch.select("doc_id", sg.line_chunks(F.col("text")).alias("chunks"))
        return keyed_chunks(sg.explode_pieces(pieces, "chunks", "doc_id"))

    def embed(chunks: DataFrame) -> DataFrame:
        return rt.embed_text(chunks, dims=DIMS)

    for name in ("first", "again"):
        grown = ms.stream_index(file_stream(spark, sf_dir, "documents", DOCUMENT), to_chunks, embed, path, name)
    return grown.select("key", F.length("text").alias("n_chars"), F.size("embedding").alias("dims"))
