"""Rule scope, static evaluation, windows and suppression at their borders."""

from datetime import datetime, timedelta

from auditweft.operators import alerts, normalize, reports, rules
from auditweft.sources.schemas import EVENT, RAW_EVENT, RULE

FIELDS = [f.strip().split(" ")[0] for f in EVENT.split(",")]
START = datetime(2024, 5, 1, 12, 0, 0)


def event(i, at=0.0, **kw):
    base = dict(id=str(i), timestamp_utc=START + timedelta(seconds=at), server="FS01", share="Dados", path=f"\\\\FS01\\Dados\\f{i}.txt", object_type="file", action="deleted", user="ana", result="success", severity="info", source="x")
    base.update(kw)
    return tuple(base.get(f) for f in FIELDS)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def rule(spark, **kw):
    base = dict(rule="mass-delete", enabled=True, severity="critical", threshold=3)
    base.update(kw)
    names = [f.strip().split(" ")[0] for f in RULE.split(",")]
    return rules.normalize_rules(spark.createDataFrame([tuple(base.get(n) for n in names)], RULE))


def test_static_rules(spark):
    lowered = rules.normalize_rules(rules.default_rules(spark, {"mass-delete": (3, None), "possible-ransomware": (50, 2)}))
    rows = [event(i) for i in range(3)] + [event(9, action="permission_changed", user="bo")] + [event(20 + i, action="modified", user="eve", extension=".LOCKED") for i in range(2)]
    got = {(r.rule, r.user): (r.severity, r.event_count) for r in rules.evaluate_rules(frame(spark, rows), lowered).collect()}
    assert got == {("mass-delete", "ana"): ("critical", 3), ("permission-change", "bo"): ("high", 1), ("possible-ransomware", "eve"): ("critical", 2)}


def test_seed_scenario(spark):
    rows = [event(i, i * 0.1) for i in range(55)] + [event(100 + i, i, action="modified", user="eve", extension=".locked") for i in range(12)] + [event(200, action="permission_changed", user="bo")]
    got = {r.rule: (r.severity, r.event_count) for r in rules.evaluate_rules(frame(spark, rows), rules.normalize_rules(rules.default_rules(spark))).collect()}
    assert got == {"mass-delete": ("critical", 55), "possible-ransomware": ("critical", 12), "permission-change": ("high", 1)}


def test_hours_days_and_zones(spark):
    rows = [event(h, h * 3600) for h in range(24)]  # from noon on a Wednesday
    ids = lambda **kw: sorted(int(r.id) for r in rules.rule_applies(frame(spark, rows), rule(spark, **kw)).collect())
    assert ids(active_from_hour=22, active_to_hour=2) == [10, 11, 12, 13]
    assert ids(active_from_hour=5, active_to_hour=5) == []
    assert ids(active_days="quinta") == list(range(12, 24))
    assert ids(active_days="qui", time_zone_id="Nowhere") == [] and ids(time_zone_id="Nowhere") == list(range(24))
    assert ids(active_from_hour=9, active_to_hour=10, time_zone_id="America/Sao_Paulo") == [0]
    assert rule(spark, time_zone_id="Nowhere", threshold=0).first().errors == ["threshold is required", "unknown time zone"]


def test_window_is_closed_and_counts_peers(spark):
    r = rule(spark)
    at = lambda *ts: frame(spark, [event(i, t) for i, t in enumerate(ts)])
    assert alerts.simulate_rule(at(0, 150, 300), r, 5).count() == 1
    assert alerts.simulate_rule(at(0, 150, 300.001), r, 5).count() == 0
    assert alerts.simulate_rule(at(7, 7, 7), r, 5).count() == 1
    # a later event that the rule doesn't count is an evaluation point: the oldest hit has left by then
    later = frame(spark, [event(i, t) for i, t in enumerate((0, 100, 200, 250))] + [event(9, 320, action="accessed")])
    assert sorted(x.event_count for x in alerts.simulate_rule(later, r, 5).collect()) == [3, 3, 4]


def test_suppression_border(spark):
    r = rule(spark, threshold=1)
    fired = lambda *ts: sorted(x.fired_us % 10**10 // 10**6 for x in alerts.detect_alerts(frame(spark, [event(i, t) for i, t in enumerate(ts)]), r, 5, 10).collect())
    base = int(START.timestamp()) % 10**4
    assert len(fired(0, 600)) == 1 and len(fired(0, 600.001)) == 2
    assert len(fired(0, 400, 700, 1100)) == 2  # suppressed firings don't extend the quiet time
    assert base >= 0


def test_baseline_border_counts_twice(spark):
    day = 86400
    rows = [event(0, 0), event(1, -day), event(2, -2 * day), event(3, 10)]
    start, end = "2024-05-01 12:00:00", "2024-05-02 12:00:00"
    got = {r.name: r for r in reports.baseline_anomalies(frame(spark, rows), start, end, windows=2).filter("dimension = 'user'").collect()}
    assert got["ana"].current_count == 2 and got["ana"].baseline_average == 2.0  # 1 at the start, 2 at the inner border, 1 at the first


def test_normalize_defaults(spark):
    raw = [(None, " FS01\t", "Dados", "D:\\x\\A.XLSX", " ", "File", " MODIFIED ", "ana", None, None, "", None, 5, None, None, " ", None)]
    r = normalize.normalize_events(spark.createDataFrame(raw, RAW_EVENT), "2024-01-01 00:00:00").first()
    assert (r.server, r.object_type, r.action, r.extension, r.previous_path, r.result, r.severity, r.source) == ("FS01", "file", "modified", ".xlsx", None, "success", "info", "manual-ingest")
    assert len(r.id) == 64 and r.timestamp_utc == datetime(2024, 1, 1)


def test_case_mixed_names_are_one(spark):
    rows = [event(i, i, user=u, server=s) for i, (u, s) in enumerate([("Ana", "FS01"), ("ANA", "fs01"), ("ana", "Fs01")])]
    (r,) = rules.evaluate_rules(frame(spark, rows), rule(spark)).collect()
    assert (r.event_count, r.user, r.server) == (3, "Ana", "FS01")
