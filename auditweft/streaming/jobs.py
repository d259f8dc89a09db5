"""Streaming jobs: ingest, alerts with keyed state, sliding activity, exactly-once collection, heartbeats."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.fleet import cursor_key, latest_heartbeats
from ..operators.normalize import normalize_events, split_rejects
from ..operators.rules import MAX_RULES, counted_action, rule_applies, suspicious
from ..sources.schemas import COLLECTED

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, path: str, fmt: str = "json", schema: str = COLLECTED) -> DataFrame:
    """Collected files as a stream of normalised events; rows without a required field are left out."""
    raw = spark.readStream.schema(schema).format(fmt).load(path)
    ok, _ = split_rejects(raw)
    return normalize_events(ok, F.current_timestamp())


def write_events(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to the event table by day; the checkpoint keeps what was read, so nothing comes twice."""
    out = df.withColumn("event_date", F.to_date("timestamp_utc")).writeStream.format("parquet").partitionBy("event_date").option("checkpointLocation", checkpoint).option("path", path)
    return (out.trigger(availableNow=True) if once else out).start()


def stream_activity(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding counts per server, user and action."""
    w = F.window("timestamp_utc", window, slide)
    return (
        events.withWatermark("timestamp_utc", late)
        .groupBy(w, F.lower("server").alias("server"), F.lower("user").alias("user"), F.lower("action").alias("action"))
        .agg(F.count("*").alias("event_count"))
        .select(F.col("window.start").alias("window_start"), "server", "user", "action", "event_count")
    )


def stream_dedup(collected: DataFrame, late: str = "10 minutes") -> DataFrame:
    """At-least-once resends become one row per feed, volume and number."""
    key = cursor_key(F.col("cursor_type"), F.col("volume"), F.col("usn"), F.col("record_id"))
    return collected.withColumn("cursor_key", key).withWatermark("timestamp_utc", late).dropDuplicatesWithinWatermark(["cursor_key"])


def stream_heartbeats(beats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest heartbeat per agent: each batch is merged into the table at ``path``/v<batch>."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{n - 1}"))
        latest_heartbeats(rows).write.mode("overwrite").parquet(f"{path}/v{n}")

    return beats.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class AlertProcessor(StatefulProcessor):
    """Recent hits and last alerts of one (server, user).

    Events wait until the watermark passes them, so that they are judged in the order of event time. What
    was judged stays as one queue of hits per rule, as long as a window; each hit enters and leaves its
    queue once, and running counts stand for the window. State expires: once the watermark is a window and
    the suppression time past a key's last event, nothing is left of the key.
    """

    def __init__(self, rules: list[dict], window_us: int, dedup_us: int):
        self.rules, self.window, self.dedup = rules, window_us, dedup_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, hits long, mark boolean")
        self.queue = handle.getListState("queue", "us long, hits long, mark boolean")
        self.last = handle.getMapState("last", "rule string", "us long")

    def _wake(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.appendList([(int(u), int(h), bool(m)) for pdf in rows for u, h, m in zip(pdf["us"], pdf["hits"], pdf["mark"])])
        # older timers go when this one has come
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._judge(key, timerValues.getCurrentWatermarkInMs() * 1000)
        if len(out):
            yield out

    def _judge(self, key, upto: int) -> pd.DataFrame:
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] <= upto else later).append(tuple(r))
        before = [tuple(r) for r in self.queue.get()]
        fired, queue = self._fire(sorted(due), before)
        # each look at the state is a message to another process: it is read once and written once
        stored = {k[0]: v[0] for k, v in self.last.iterator()}
        last, out = dict(stored), []
        for t, i, n, upper, first, newest in fired:
            rule = self.rules[i]
            if t - last.get(rule["rule"], t - self.dedup - 1) <= self.dedup:
                continue
            last[rule["rule"]] = t
            single = rule["rule"] == "permission-change"
            out.append((rule["rule"], (rule["secondary_severity"] or rule["severity"]) if upper else rule["severity"], *key, 1 if single else n, first, first if single else newest, t))
        # what comes later is judged after ``upto``, so older hits can't be in its window any more
        queue = [r for r in queue if r[0] > upto - self.window]
        if queue != before:
            _put(self.queue, queue)
        if due:
            _put(self.waiting, later)
        last = {k: t for k, t in last.items() if t >= upto - self.dedup}
        for k in stored.keys() - last.keys():
            self.last.removeKey((k,))
        for k, t in last.items():
            if stored.get(k) != t:
                self.last.updateValue((k,), (t,))
        if later:
            self._wake(min(r[0] for r in later) // 1000 + 1)
        elif queue or last:
            self._wake((upto + max(self.window, self.dedup)) // 1000 + 2)
        return pd.DataFrame(out, columns=_ALERT_COLUMNS)

    def _fire(self, due: list[tuple], before: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(time, rule number, hits, secondary reached, first, newest) at each time of the sorted rows, and all hits in order.

        A rule's own queue is trimmed whenever it is looked at; rules without a hit in the window aren't.
        """
        queues: dict[int, deque] = {}
        marks: dict[int, int] = {}

        def push(r: tuple) -> None:
            if r[1] >= 0:
                queues.setdefault(r[1], deque()).append(r)
                marks[r[1]] = marks.get(r[1], 0) + r[2]

        for r in before:
            push(r)
        fired = []
        for t, same in groupby(due, key=lambda r: r[0]):
            for r in same:
                push(r)
            for i in sorted(queues):
                q = queues[i]
                while q and q[0][0] < t - self.window:
                    marks[i] -= q.popleft()[2]
                if not q:
                    del queues[i], marks[i]
                    continue
                rule = self.rules[i]
                upper = bool(rule["secondary_threshold"]) and marks[i] >= rule["secondary_threshold"]
                if upper or len(q) >= (rule["threshold"] or 1):
                    fired.append((t, i, len(q), upper, q[0][0], q[-1][0]))
        return fired, sorted(r for q in queues.values() for r in q)

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    """The list state, which holds rows, holds these and nothing else."""
    if rows:
        state.put(rows)
    else:
        state.clear()


_ALERT_COLUMNS = ["rule", "severity", "server", "user", "event_count", "first_us", "last_us", "fired_us"]


def stream_alerts(events: DataFrame, rules: DataFrame, window_min: int = 5, dedup_min: int = 10, late: str = "10 minutes") -> DataFrame:
    """Alerts from a stream of events: the same rows as the batch detection on the same events."""
    on = rules.filter("enabled")
    cols = ["rule", "severity", "threshold", "secondary_threshold", "secondary_severity"]
    name = lambda prefix: F.to_json(F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in cols)))
    # rows of one rule with equal limits and other scopes count together, as in the batch detection
    names = [r.asDict() for r in on.select(*cols, name("").alias("_name")).distinct().orderBy("_name").limit(MAX_RULES + 1).collect()]
    if len(names) > MAX_RULES:
        raise ValueError("more rules than a dimension table holds")
    number = F.array_position(F.array(*(F.lit(r["_name"]) for r in names)).cast("array<string>"), name("r_")) - 1
    scoped = rule_applies(events, on)
    rows = scoped.select(
        "timestamp_utc", F.lower("server").alias("server"), F.lower("user").alias("user"), F.unix_micros("timestamp_utc").alias("us"),
        F.when(counted_action(), number).otherwise(-1).cast("long").alias("hits"), suspicious().alias("mark"),
    )
    return (
        rows.withWatermark("timestamp_utc", late)
        .groupBy("server", "user")
        .transformWithStateInPandas(
            AlertProcessor(names, window_min * 60_000_000, dedup_min * 60_000_000),
            "rule string, severity string, server string, user string, event_count long, first_us long, last_us long, fired_us long",
            outputMode="append",
            timeMode="eventTime",
        )
    )


def newest_version(path: str, query: StreamingQuery) -> str:
    """Where the heartbeats' last batch left the table."""
    return f"{path}/v{max(p['batchId'] for p in query.recentProgress)}" if query.recentProgress else f"{path}/v0"


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of whole results over what is there now; every batch overwrites its own table at ``path``."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{n}")

    q = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(newest_version(path, q))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into parquet and return the rows."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
