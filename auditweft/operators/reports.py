"""Searches, summaries, baseline comparison and dashboard aggregates over audit events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean, is_blank

DIMENSIONS = ["action", "share", "user"]


def limit_of(take: int | None, most: int, default: int) -> int:
    """A take outside 1..most falls back to the default; it isn't clamped."""
    return take if take is not None and 1 <= take <= most else default


def store_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("event_count"), F.max("timestamp_utc").alias("latest_utc"))


def in_range(start, end, col: str = "timestamp_utc") -> Column:
    """Closed at both ends; an open end is None."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (F.col(col) <= F.lit(end).cast("timestamp"))
    return out


def matches(server=None, user=None, action=None, path=None, share=None) -> Column:
    """Literal, case-insensitive containment for server, user, path and share; equality for the action."""
    out = F.lit(True)
    for col, v in (("server", server), ("user", user), ("path", path), ("share", share)):
        if v and v.strip():
            out = out & F.contains(F.lower(F.col(col)), F.lit(v.strip().lower()))
    if action and action.strip():
        out = out & (F.lower("action") == action.strip().lower())
    return out


def search_events(df: DataFrame, server=None, user=None, action=None, path=None, start=None, end=None, take: int = 100, most: int = 500, default: int = 100) -> DataFrame:
    """Newest first; equal times by id."""
    n = limit_of(take, most, default)
    return df.filter(matches(server, user, action, path) & in_range(start, end)).orderBy(F.desc("timestamp_utc"), "id").limit(n)


def find_event(df: DataFrame, event_id: str) -> DataFrame:
    return df.filter(F.col("id") == event_id)


def text_search(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    t = (term or "").strip().lower()
    if not t:
        return df
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(t)), F.lit(False)) for c in cols)))


def latest_batch(df: DataFrame, n: int, ts: str = "timestamp_utc", tie: str = "id") -> DataFrame:
    """The newest n rows, oldest first."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n).orderBy(ts, tie)


def _shown(name: str) -> Column:
    """One spelling of a name that is grouped without case: that of the earliest event."""
    return F.min_by(name, F.struct("timestamp_utc", "id"))


def activity_summary(df: DataFrame, start=None, end=None, server=None, share=None, user=None, action=None, take: int = 10) -> DataFrame:
    """dimension, name, event_count: the total (dimension 'total') and the top names per dimension.

    Each event becomes one row per dimension before a partial aggregation, so one scan serves all.
    """
    n = limit_of(take, 100, 10)
    own = df.filter(matches(server, user, action, None, share) & in_range(start, end))
    named = [F.struct(F.lit(d).alias("dimension"), F.lower(d).alias("key"), F.col(d).alias("name")) for d in DIMENSIONS]
    total = F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key"), F.lit("all").alias("name"))
    rows = own.select("timestamp_utc", "id", F.explode(F.array(total, *named)).alias("g")).select("timestamp_utc", "id", "g.*")
    counts = rows.groupBy("dimension", "key").agg(_shown("name").alias("name"), F.count("*").alias("event_count"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("event_count"), "key"))
    return counts.withColumn("r", rank).filter(F.col("r") <= n).select("dimension", "name", "event_count")


def baseline_anomalies(df: DataFrame, start: str, end: str, windows: int = 7, take: int = 8, **filters) -> DataFrame:
    """dimension, name, current_count, baseline_average, delta_percent against the windows before.

    All windows are as long as [start, end] and closed at both ends, so a row on the border of two
    windows counts in both. One scan over all of them.
    """
    us = lambda s: F.unix_micros(F.lit(s).cast("timestamp"))
    ts, a, b = F.unix_micros("timestamp_utc"), us(start), us(end)
    width = F.nullif(b - a, F.lit(0))
    # windows back from the start: k = 0 is the current one
    k = F.floor((b - ts) / width).cast("int")
    edge = F.coalesce((b - ts) % width == 0, F.lit(False))
    first = F.coalesce(b - width * (windows + 1), a)
    own = df.filter(matches(**filters) & (ts >= first) & (ts <= b))
    current = F.when(ts >= a, 1).otherwise(0)
    earlier = F.when(ts == first, 1).when(ts > a, 0).when(edge & (k == 1), 1).when(edge, 2).otherwise(1)
    same = a == b
    named = [F.struct(F.lit(d).alias("dimension"), F.lower(d).alias("key"), F.col(d).alias("name")) for d in DIMENSIONS]
    rows = own.select(
        "timestamp_utc",
        "id",
        current.alias("c"),
        F.when(same, F.lit(windows)).otherwise(earlier).alias("e"),
        F.explode(F.array(*named)).alias("g"),
    ).select("timestamp_utc", "id", "c", "e", "g.*")
    sums = rows.groupBy("dimension", "key").agg(
        F.min_by("name", F.struct((1 - F.col("c")).alias("past"), "timestamp_utc", "id")).alias("name"), F.sum("c").alias("current_count"), F.sum("e").alias("past")
    )
    average = F.col("past") / F.lit(float(max(1, windows)))
    delta = F.when(average <= 0, F.lit(100.0)).otherwise((F.col("current_count") - average) / average * 100)
    out = sums.filter("current_count > 0").select("dimension", "key", "name", "current_count", F.bround(average, 2).alias("baseline_average"), F.bround(delta, 2).alias("delta_percent"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("delta_percent"), F.desc("current_count"), "key"))
    return out.withColumn("r", rank).filter(F.col("r") <= take).drop("r", "key")


def investigation_summary(df: DataFrame) -> DataFrame:
    """event_count, user_count, dominant_action (ties: by name)."""
    per_action = df.groupBy(F.lower("action").alias("action")).agg(F.count("*").alias("n"))
    top = per_action.agg(F.sum("n").alias("event_count"), F.min_by("action", F.struct(-F.col("n"), "action")).alias("dominant_action"))
    users = df.agg(F.countDistinct(F.lower("user")).alias("user_count"))
    return top.join(users).select(F.coalesce("event_count", F.lit(0)).alias("event_count"), "user_count", "dominant_action")  # one row each


def operational_posture(alerts: DataFrame, agents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """open_alerts, critical_open, agents_attention, highest_anomaly, posture."""
    a = alerts.agg(
        F.count_if(F.lower("status") == "open").alias("open_alerts"), F.count_if((F.lower("status") == "open") & (F.lower("severity") == "critical")).alias("critical_open")
    )
    g = agents.agg(F.count_if((F.lower("status") != "running") | (F.col("pending_queue_events") > 0)).alias("agents_attention"))
    h = anomalies.agg(F.coalesce(F.max("delta_percent"), F.lit(0.0)).alias("highest_anomaly"))
    posture = F.when((F.col("critical_open") > 0) | (F.col("highest_anomaly") >= 150), "high").when(
        (F.col("open_alerts") > 0) | (F.col("agents_attention") > 0) | (F.col("highest_anomaly") >= 60), "watch"
    )
    return a.join(g).join(h).withColumn("posture", posture.otherwise("stable"))  # one row each


def fleet_counts(agents: DataFrame, paths: DataFrame, rules: DataFrame, audit: DataFrame) -> DataFrame:
    g = agents.agg(
        F.count_if(F.col("status") == "stale").alias("stale_agents"),
        F.count_if(F.col("status") == "backlog").alias("backlog_agents"),
        F.count_if(~F.col("status").isin("running", "stale", "backlog")).alias("degraded_agents"),
        F.count_if(F.col("pending_queue_events") > 0).alias("queued_agents"),
    )
    p = paths.agg(F.count_if(F.lower("status") == "active").alias("active_paths"), F.count_if(F.lower("priority").isin("high", "critical")).alias("priority_paths"))
    r = rules.agg(F.count_if("enabled").alias("enabled_rules"))
    d = audit.agg(F.countDistinct(F.lower(clean(F.when(~is_blank(F.col("actor")), F.col("actor"))))).alias("actors"))
    return g.join(p).join(r).join(d)  # one row each
