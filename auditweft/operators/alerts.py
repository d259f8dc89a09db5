"""Alerts over time: rule simulation, detection with suppression, look-ups and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import path_key, severity_rank
from .hydrate import cut
from .reports import limit_of
from .rules import counted_action, raised_severity, reached, rule_applies, suspicious
from .skew import dealt

_MINUTE = 60_000_000


RULE = [f"r_{c}" for c in ("rule", "severity", "threshold", "secondary_threshold", "secondary_severity")]
WHO = ["server_key", "user_key"]


def _sliced(rows: DataFrame, length: int, before: int, after: int) -> DataFrame:
    """Rows by time slices of ``length``: each in its own slice (``own``), and near a slice's border also beyond it.

    A slice then holds all that happened from ``before`` ahead of it to ``after`` behind it, so that one
    user's or server's time line is spread over as many tasks as it has slices.
    """
    us = F.col("us")
    at = lambda t: F.floor(t / F.lit(length))
    slices = F.sequence(at(us - after), at(us + before))
    return rows.withColumn("slice", F.explode(slices)).withColumn("own", F.col("slice") == at(us))


def _moments(events: DataFrame, rules: DataFrame, counted_only: bool) -> DataFrame:
    """Per rule, server, user and time: the scoped events, n of them that the rule counts, m suspicious ones of these.

    Times without a counted event have n = 0; they stay unless ``counted_only``.
    """
    scoped = rule_applies(events, rules).select(
        *RULE, F.lower("server").alias("server_key"), F.lower("user").alias("user_key"), F.unix_micros("timestamp_utc").alias("us"), counted_action().alias("hit"), suspicious().alias("mark")
    )
    if counted_only:
        scoped = scoped.filter("hit")
    return cut(scoped.groupBy(*RULE, *WHO, "us").agg(F.count("*").alias("scoped"), F.count_if("hit").alias("n"), F.count_if(F.col("hit") & F.col("mark")).alias("m")))


def _firings(moments: DataFrame, events: DataFrame | None, window_us: int) -> DataFrame:
    """Times at which a rule's count in the trailing window reaches its threshold.

    Evaluation points are the moments, or with ``events`` the times of all events of the same server and
    user. Time lines are cut into slices of four windows with one window ahead of them; slices whose hits
    together don't reach the threshold go first. Counts are differences of running counts at a window's
    two ends, so the work is linear in rows however many share a window.
    """
    hits = _sliced(moments.filter("n > 0"), 4 * window_us, window_us, 0)
    able = hits.groupBy(*RULE, *WHO, "slice").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter(reached(F.col("n"), F.col("m"))).select(*RULE, *WHO, "slice")
    if events is None:
        points = _sliced(moments, 4 * window_us, 0, 0).join(able.select("r_rule", *WHO, "slice").distinct(), ["r_rule", *WHO, "slice"], "left_semi")
    else:
        every = events.select(F.lower("server").alias("server_key"), F.lower("user").alias("user_key"), F.unix_micros("timestamp_utc").alias("us")).distinct()
        points = _sliced(every, 4 * window_us, 0, 0).join(able, [*WHO, "slice"])
    ends = F.array(F.struct((F.col("us") - window_us).alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("us").alias("pos"), F.lit(2).alias("kind")))
    none = F.lit(None).cast("long")
    asked = points.select(*RULE, *WHO, "slice", F.col("us").alias("at"), F.explode(ends).alias("e")).select(
        *RULE, *WHO, "slice", "at", "e.pos", "e.kind", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), none.alias("hit_us")
    )
    told = hits.join(able.select("r_rule", *WHO, "slice").distinct(), ["r_rule", *WHO, "slice"], "left_semi").select(
        *RULE, *WHO, "slice", none.alias("at"), F.col("us").alias("pos"), F.lit(1).alias("kind"), "n", "m", F.col("us").alias("hit_us")
    )
    own = Window.partitionBy(*RULE, *WHO, "slice")
    so_far = own.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    to_come = own.orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    # at most two ends for every point, and points of an event by rule only where the rule has hits
    rows = 2 * (moments if events is None else events).count() + moments.count()
    run = dealt(asked.union(told), rows, *RULE, *WHO, "slice").select(
        "*", F.sum("n").over(so_far).alias("c"), F.sum("m").over(so_far).alias("d"), F.max("hit_us").over(so_far).alias("last"), F.min("hit_us").over(to_come).alias("first")
    )
    end = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = run.filter("kind <> 1").groupBy(*RULE, *WHO, "slice", F.col("at").alias("us")).agg(
        (end(2, "c") - end(0, "c")).alias("event_count"), (end(2, "d") - end(0, "d")).alias("suspicious_count"), end(0, "first").alias("first_us"), end(2, "last").alias("last_us")
    )
    fires = (F.col("event_count") > 0) & reached(F.col("event_count"), F.col("suspicious_count"))
    return out.filter(fires).withColumn("hit", F.col("last_us") == F.col("us")).drop("slice")


def _unsuppressed(fired: DataFrame, dedup_us: int) -> DataFrame:
    """(_key, us) of the firings kept: a key's first one, and each that comes more than ``dedup_us`` after the last kept one.

    A firing more than that after any other is kept in any case. From there the kept ones are a chain of
    pointers from a firing to the first one more than ``dedup_us`` later, followed in rounds that double
    the length, so that a key that never falls quiet isn't one task. Where firings lie close, that one is
    at most two dedup times away, so pointers are found in time slices.
    """
    wide = _sliced(fired.select("_key", "us"), 16 * dedup_us, dedup_us, 2 * dedup_us)
    spots = F.array(F.struct(F.col("us").alias("pos"), F.lit(0).alias("kind")), F.struct((F.col("us") + dedup_us).alias("pos"), F.lit(1).alias("kind")))
    spots = wide.select("_key", "slice", "own", "us", F.explode(spots).alias("e")).select("_key", "slice", "own", "us", "e.pos", "e.kind")
    at = F.when(F.col("kind") == 0, F.col("us"))
    own = Window.partitionBy("_key", "slice")
    ahead = own.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = own.orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt(spots, 4 * fired.count(), "_key", "slice").select("*", F.max(at).over(ahead).alias("before"), F.min(at).over(behind).alias("after")).filter("own")
    links = cut(seen.groupBy("_key", "us").agg(F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("before"), F.max(F.when(F.col("kind") == 1, F.col("after"))).alias("to")))
    kept = links.filter(F.col("before").isNull() | (F.col("us") - F.col("before") > dedup_us)).select("_key", "us")
    jump = links.filter("to IS NOT NULL").select("_key", "us", "to")
    while True:  # a pointer leads to a later firing, so every chain ends
        more = cut(kept.join(jump, ["_key", "us"]).select("_key", F.col("to").alias("us")).join(kept, ["_key", "us"], "left_anti").distinct())
        if more.isEmpty():
            return kept
        kept = cut(kept.union(more))
        jump = cut(jump.join(jump.select("_key", F.col("us").alias("to"), F.col("to").alias("to2")), ["_key", "to"]).select("_key", "us", F.col("to2").alias("to")))


def simulate_rule(events: DataFrame, rules: DataFrame, window_min: int = 5) -> DataFrame:
    """Distinct firings of rules over past events, whether enabled or not.

    Every scoped event is an evaluation point, also those the rule doesn't count. rule, severity,
    server, user (keys), event_count, first_us, last_us. Permission changes give one firing per
    distinct time.
    """
    return _simulated(_moments(events, rules, False), window_min)


def _simulated(moments: DataFrame, window_min: int) -> DataFrame:
    fired = _firings(moments, None, window_min * _MINUTE)
    single = F.col("r_rule") == "permission-change"
    fired = fired.filter(~single | F.col("hit"))
    return fired.select(
        F.col("r_rule").alias("rule"),
        raised_severity(F.col("suspicious_count")).alias("severity"),
        F.col("server_key").alias("server"),
        F.col("user_key").alias("user"),
        F.when(single, F.lit(1).cast("long")).otherwise(F.col("event_count")).alias("event_count"),
        F.when(single, F.col("us")).otherwise(F.col("first_us")).alias("first_us"),
        F.when(single, F.col("us")).otherwise(F.col("last_us")).alias("last_us"),
    ).dropDuplicates(["rule", "server", "user", "event_count", "first_us", "last_us"])


def simulation_counts(events: DataFrame, rules: DataFrame, window_min: int = 5) -> DataFrame:
    """rule, evaluated (scoped events), matching (counted ones), alerts."""
    moments = _moments(events, rules, False)
    a = moments.groupBy(F.col("r_rule").alias("rule")).agg(F.sum("scoped").alias("evaluated"), F.sum("n").alias("matching"))
    b = _simulated(moments, window_min).groupBy("rule").agg(F.count("*").alias("alerts"))
    return a.join(b, "rule", "left").fillna(0, ["alerts"])


def detect_alerts(events: DataFrame, rules: DataFrame, window_min: int = 5, dedup_min: int = 10) -> DataFrame:
    """Alerts as a live run would have raised them, on event time.

    Every event of (server, user) is an evaluation point. A firing is kept only if it comes more than
    the dedup time after the last kept one of its key; suppressed firings don't extend the quiet
    time. Within one key only one firing per microsecond counts.
    """
    fired = _firings(_moments(events, rules.filter("enabled"), True), events, window_min * _MINUTE)
    fired = cut(fired.withColumn("_key", F.to_json(F.struct(*RULE, *WHO))))
    k = fired.join(_unsuppressed(fired, dedup_min * _MINUTE), ["_key", "us"])
    single = F.col("r_rule") == "permission-change"
    return k.select(
        F.col("r_rule").alias("rule"),
        raised_severity(F.col("suspicious_count")).alias("severity"),
        F.col("server_key").alias("server"),
        F.col("user_key").alias("user"),
        F.when(single, F.lit(1).cast("long")).otherwise(F.col("event_count")).alias("event_count"),
        F.col("first_us"),
        F.when(single, F.col("first_us")).otherwise(F.col("last_us")).alias("last_us"),
        F.col("us").alias("fired_us"),
    )


def notify_filter(alerts: DataFrame, min_severity: str) -> DataFrame:
    return alerts.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))


def query_alerts(df: DataFrame, severity: str | None = None, status: str | None = None, take: int = 100) -> DataFrame:
    out = df
    for c, v in (("severity", severity), ("status", status)):
        if v:
            out = out.filter(F.lower(c) == v.lower())
    return out.orderBy(F.desc("created_utc"), "id").limit(limit_of(take, 500, 100))


def acknowledge_alerts(df: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Alerts whose id is among ``ids`` become acknowledged at the given time."""
    chosen = ids.select(F.col("id").alias("_ack")).distinct()
    out = df.join(chosen, F.col("id") == F.col("_ack"), "left")
    hit = F.col("_ack").isNotNull()
    return (
        out.withColumn("status", F.when(hit, "acknowledged").otherwise(F.col("status")))
        .withColumn("acknowledged_utc", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("acknowledged_utc")))
        .drop("_ack")
    )


def recent_alert_exists(new: DataFrame, stored: DataFrame, dedup_min: int) -> DataFrame:
    """New alerts without a stored one of the same key from ``dedup_min`` minutes before on."""
    old = stored.select(F.lower("dedup_key").alias("_key"), F.unix_micros("created_utc").alias("_at")).groupBy("_key").agg(F.max("_at").alias("_at"))
    return new.join(old, (F.lower(new["dedup_key"]) == F.col("_key")) & (F.col("_at") >= F.unix_micros(new["created_utc"]) - dedup_min * _MINUTE), "left_anti")


def alert_operations(alerts: DataFrame, events: DataFrame, margin_min: int = 10) -> DataFrame:
    """alert_id and events near each alert: newest clamp(4 * count, 100, 500) of its server and user,
    then those on or below a sample path (all, without samples)."""
    hour = 3_600_000_000
    a = alerts.select(
        F.col("id").alias("alert_id"), F.lower("server").alias("_s"), F.lower("user").alias("_u"),
        (F.unix_micros("first_event_utc") - margin_min * _MINUTE).alias("_lo"), (F.unix_micros("last_event_utc") + margin_min * _MINUTE).alias("_hi"),
        F.greatest(F.lit(100), F.least(F.lit(500), F.col("event_count") * 4)).alias("_quota"), "sample_paths",
    )
    a = a.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("_lo") / hour), F.floor(F.col("_hi") / hour))))
    e = events.withColumn("_us", F.unix_micros("timestamp_utc")).withColumn("_hour", F.floor(F.col("_us") / hour))
    e = e.withColumn("_s", F.lower("server")).withColumn("_u", F.lower("user"))
    near = e.join(a, ["_hour", "_s", "_u"]).filter(F.col("_us").between(F.col("_lo"), F.col("_hi")))
    rank = F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc("_us"), "id"))
    near = near.withColumn("_r", rank).filter(F.col("_r") <= F.col("_quota"))
    keys = [path_key(F.col("path")), path_key(F.col("previous_path"))]
    under = lambda s: F.coalesce(F.startswith(keys[0], path_key(s)), F.lit(False)) | F.coalesce(F.startswith(keys[1], path_key(s)), F.lit(False))
    keep = (F.coalesce(F.size("sample_paths"), F.lit(0)) <= 0) | F.exists("sample_paths", under)
    return near.filter(keep).select("alert_id", *events.columns)
