"""Connections with explicit ends, by keyed state with event-time timers, and users who fall silent, by windows.

Rows of a key may come in any order and in any batches. They wait in the state until the
watermark has passed them and are then taken in the order of their times, so that the result does
not depend on how the stream was cut; rows later than the watermark allows are dropped by Spark.
A key's state holds the rows that wait and a few numbers, and is removed when nothing is open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeloom.streaming.messages import PING_SECONDS

# Fixed value: seconds after which a connection without messages counts as given up.
CONNECTION_SECONDS = 30

#: Keyed state with timers needs this state store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CONNECT, DISCONNECT, SENT, RECEIVED = "connect", "disconnect", "sent", "received"
CONNECTION = "user_id bigint, connected_at bigint, closed_at bigint, messages_sent bigint, messages_received bigint, reason string"


class _Connections(StatefulProcessor):
    """Opens, counts and closes the connections of a user; times in microseconds."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "since bigint, last bigint, sent bigint, received bigint")
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at, r.seq, r.kind) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(at for at, _, _ in new))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r[0], r[1], r[2]) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        now = list(self.open.get()) if self.open.exists() else None
        out = []

        def close(at: int, reason: str) -> None:
            since, _, sent, received = now
            out.append(Row(user_id=key[0], connected_at=since, closed_at=at, messages_sent=sent, messages_received=received, reason=reason))

        for at, _, kind in due:
            if now and at - now[1] >= self.idle:
                close(now[1] + self.idle, "idle")
                now = None
            if kind == CONNECT:
                if now:
                    close(at, "replaced")
                now = [at, at, 0, 0]
            elif now and kind == DISCONNECT:
                close(at, "disconnect")
                now = None
            elif now:
                now[1] = at
                now[2] += kind == SENT
                now[3] += kind == RECEIVED
        if now and now[1] + self.idle <= passed:
            close(now[1] + self.idle, "idle")
            now = None
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        elif rows:
            self.waiting.clear()
        if now:
            self.open.update(tuple(now))
            self._wake(now[1] + self.idle)
        elif self.open.exists():
            self.open.clear()
        return iter(out)


def connections(events: DataFrame, kind: Column, seq: Column, idle_seconds: float = CONNECTION_SECONDS, late: str = "1 minute") -> DataFrame:
    """One row per connection of a user: when it was opened and closed, its messages, and why it was closed.

    ``events``: user_id, ts. ``kind`` is connect, disconnect, sent or received (else: only a sign of life);
    ``seq`` orders events of one time. A connection ends with a disconnect, with a new connect of
    the same user (``replaced``), or when nothing came for ``idle_seconds`` (``idle``, ended by a timer). Without
    an open connection a message is not counted and a disconnect does nothing. Times are given in microseconds.
    """
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), seq.cast("bigint").alias("seq"), kind.alias("kind"))
    kept = rows.filter(F.col("user_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull())
    return kept.groupBy("user_id").transformWithState(_Connections(round(idle_seconds * 1e6)), CONNECTION, "append", "EventTime")


def silent_windows(messages: DataFrame, ping: Column, seconds: int = PING_SECONDS, gone_after: int = 3, late: str = "1 minute") -> DataFrame:
    """Messages and pings of each user in every ping interval, those without a message included.

    A user's windows start with a message and go on until ``gone_after`` windows in a row were silent: that
    row says ``gone``, and the user is watched again from the next message on. ``idle`` means no
    ping, ``silent`` no message at all. A window comes out when the watermark has passed it, so a user who sends nothing more still shows.

    Both steps are Spark's own window aggregations: messages are counted per ping interval (a late row counts while
    its interval is open), then each interval is seen by the ``gone_after`` + 1 sliding windows it lies in. A sliding window stands
    for its last interval, and is silent for as long as the latest interval with messages lies back.
    """
    width = seconds * 1_000_000
    rows = messages.withWatermark("ts", late).select("user_id", "ts", ping.alias("ping"))
    kept = rows.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    counted = kept.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ping").alias("pings"))
    seen = F.window(F.col("w"), f"{seconds * (gone_after + 1)} seconds", f"{seconds} seconds").alias("near")
    last = F.max(F.struct(F.unix_micros("w.start").alias("start"), "n", "pings")).alias("last")
    watched = counted.groupBy("user_id", seen).agg(last)
    start = F.unix_micros("near.end") - width
    silent = F.col("last.start") < start
    return watched.select(
        "user_id",
        start.alias("window_start"),
        F.when(silent, 0).otherwise(F.col("last.n")).cast("bigint").alias("n_messages"),
        F.when(silent, 0).otherwise(F.col("last.pings")).cast("bigint").alias("n_pings"),
        (silent | (F.col("last.pings") == 0)).alias("idle"),
        silent.alias("silent"),
        (start - F.col("last.start") == gone_after * width).alias("gone"),
    )
