"""Sorted passes are dealt by their number of rows, so that a task's share doesn't grow with the input."""

from auditweft.operators import alerts, rules, skew, timeline
from pyspark.sql import functions as F


def events(spark):
    n = F.col("id")
    return spark.range(300).select(
        n.cast("string").alias("id"), F.timestamp_seconds(1_700_000_000 + n * 20).alias("timestamp_utc"), F.lit("S").alias("server"), F.lit("D").alias("share"), F.concat(F.lit("\\\\S\\D\\d"), n % 3, F.lit("\\f"), n % 7).alias("path"),
        F.lit(None).cast("string").alias("previous_path"), F.when(n % 2 == 0, "deleted").otherwise("modified").alias("action"), F.concat(F.lit("u"), n % 4).alias("user"),
        *(F.lit(None).cast("string").alias(c) for c in ("source_host", "process_name", "extension")),
    )


def parts(df, keys: str) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return max(int(line.rsplit(",", 1)[1].strip()) for line in plan.splitlines() if "RepartitionByExpression" in line and keys in line)


def test_trailing_windows_are_dealt_by_rows(spark, monkeypatch):
    e, r = events(spark), rules.normalize_rules(rules.default_rules(spark, {"mass-delete": (3, None)}))
    want = sorted(map(tuple, alerts.detect_alerts(e, r).collect()))
    monkeypatch.setattr(skew, "ROWS", 10)
    assert parts(alerts._firings(alerts._moments(e, r, True), e, 300_000_000), "slice") >= 60
    assert want and sorted(map(tuple, alerts.detect_alerts(e, r).collect())) == want


def test_echoes_are_dealt_by_rows(spark, monkeypatch):
    e = events(spark)
    want = sorted(map(tuple, timeline.suppress_echoes(e).collect()))
    monkeypatch.setattr(skew, "ROWS", 10)
    out = timeline.suppress_echoes(e)
    assert parts(out, "_slot") >= 120
    assert want and sorted(map(tuple, out.collect())) == want
