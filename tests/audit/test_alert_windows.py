"""Trailing windows in time slices and suppression by pointers against a plain pass in time order."""

import random
from bisect import bisect_left, bisect_right

from auditweft.operators import alerts
from pyspark.sql import functions as F
from test_rules import event, frame, rule

US = 1_000_000


def plain_firings(times, threshold, window_us):
    """(time, count, first, last) of each distinct time of one key whose window reaches the threshold."""
    hits = sorted(t for t, hit in times if hit)
    out = []
    for t in sorted({t for t, _ in times}):
        a, b = bisect_left(hits, t - window_us), bisect_right(hits, t)
        if b - a >= threshold:
            out.append((t, b - a, hits[a], hits[b - 1]))
    return out


def plain_kept(firings, dedup_us):
    kept = []
    for f in firings:
        if not kept or f[0] - kept[-1][0] > dedup_us:
            kept.append(f)
    return kept


def test_equals_a_plain_pass_with_one_busy_user(spark):
    """Half of all events belong to one user who is never quiet; their time line spans many slices."""
    rng = random.Random(8)
    rows, at = [], 0.0
    for i in range(1200):
        at += rng.choice([0, 0.5, 20, 40, 290, 300, 301])
        rows.append((f"b{i}", at, "busy", rng.choice(["deleted", "deleted", "accessed"])))
    for i in range(1200):
        rows.append((f"o{i}", rng.random() * at, f"u{rng.randint(0, 40)}", rng.choice(["deleted", "accessed", "modified"])))
    df = frame(spark, [event(i, t, user=u, action=a) for i, t, u, a in rows])
    r = rule(spark, rule="mass-delete", threshold=3)
    own = {}
    for x in df.select("user", "action", F.unix_micros("timestamp_utc").alias("us")).collect():
        own.setdefault(x["user"].lower(), []).append((x["us"], x["action"] == "deleted"))
    window, dedup = 5 * 60 * US, 10 * 60 * US
    want = sorted((u, *f) for u, times in own.items() for f in plain_kept(plain_firings(times, 3, window), dedup))
    got = sorted((x.user, x.fired_us, x.event_count, x.first_us, x.last_us) for x in alerts.detect_alerts(df, r, 5, 10).collect())
    assert got == want and sum(u == "busy" for u, *_ in want) > 50
    # a simulation evaluates scoped events, which here are all of them, and keeps distinct counts
    seen = {(u, *f[1:]) for u, times in own.items() for f in plain_firings(times, 3, window)}
    assert {(x.user, x.event_count, x.first_us, x.last_us) for x in alerts.simulate_rule(df, r, 5).collect()} == seen
    slices = alerts._sliced(df.select(F.lower("user").alias("user_key"), F.unix_micros("timestamp_utc").alias("us")).filter("user_key = 'busy'"), 4 * window, window, 0)
    most, n = slices.groupBy("slice").count().agg(F.max("count"), F.count("*")).first()
    assert n > 40 and most < 0.05 * 1200


def test_long_runs_of_firings(spark):
    """One firing a minute for two days: every eleventh stays, and a break starts anew."""
    minutes = [*range(0, 2880), *range(2900, 2950)]
    fired = spark.createDataFrame([("k", 60 * US * m) for m in minutes] + [("z", 5)], "_key string, us long")
    got = sorted((x["_key"], x["us"]) for x in alerts._unsuppressed(fired, 10 * 60 * US).collect())
    want = [("k", f[0]) for f in plain_kept([(60 * US * m,) for m in minutes], 10 * 60 * US)] + [("z", 5)]
    assert got == want


def test_counts_of_a_simulation_scope_events_once(spark, monkeypatch):
    scoped, seen = alerts.rule_applies, []
    monkeypatch.setattr(alerts, "rule_applies", lambda *a: seen.append(1) or scoped(*a))
    e = frame(spark, [event(i, i % 7) for i in range(40)])
    got = alerts.simulation_counts(e, rule(spark), 5).collect()
    assert len(seen) == 1 and [(r.evaluated, r.matching) for r in got] == [(40, 40)]
