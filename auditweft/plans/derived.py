"""Heartbeats, monitored paths, alerts and admin entries that both engines derive from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import audit_events


def _k() -> Column:
    return F.regexp_extract("path", r"file(\d+)", 1).cast("int")


def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    e = audit_events(spark, d).withColumn("k", _k())
    return e.filter("k % 4 = 0").select(
        F.concat("server", F.lit("-"), "share", (F.col("k") % 8).cast("string")).alias("agent_id"), "server", F.when(F.col("k") % 16 == 8, "degraded").otherwise("running").alias("status"),
        F.col("timestamp_utc").alias("last_heartbeat_utc"), F.lit("1.0").alias("version"), F.col("id").cast("long").alias("last_record_id"),
        F.lit(None).cast("map<string,bigint>").alias("last_usn_by_volume"), F.when(F.col("k") % 3 == 0, "ok").alias("message"), (F.col("k") * 20).alias("pending_queue_events"),
        F.lit(None).cast("timestamp").alias("last_successful_send_utc"),
    )


def monitored_paths(spark: SparkSession, d: str) -> DataFrame:
    e = audit_events(spark, d).withColumn("dir", (_k() % 10).cast("int")).select("server", "share", "dir").distinct()
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("dir") % n).cast("int"))
    return e.select(
        F.concat_ws("-", "server", "share", "dir").alias("id"), "server", "share", F.concat(F.lit("\\\\"), "server", F.lit("\\"), "share", F.lit("\\dir"), "dir").alias("path"),
        pick(["active", "planned", "paused"], 3).alias("status"), pick(["low", "normal", "high", "critical"], 4).alias("priority"),
    )


def alert_rows(spark: SparkSession, d: str) -> DataFrame:
    e = audit_events(spark, d).withColumn("k", _k()).filter(F.col("action").isin("deleted", "permission_changed"))
    rule = F.when(F.col("action") == "deleted", "mass-delete").otherwise("permission-change")
    return e.select(
        "id", rule.alias("rule"), F.get(F.array(*map(F.lit, ["high", "critical", "info"])), F.col("k") % 3).alias("severity"), F.when(F.col("k") % 2 == 0, "open").otherwise("acknowledged").alias("status"),
        F.concat(F.lit("Alert "), rule).alias("title"), F.concat(F.lit('Path "'), "path", F.lit('", by '), "user").alias("description"), "server", "user", (F.col("k") + 1).alias("event_count"),
        F.col("timestamp_utc").alias("first_event_utc"), F.col("timestamp_utc").alias("last_event_utc"), F.col("timestamp_utc").alias("created_utc"), F.lit(None).cast("timestamp").alias("acknowledged_utc"),
        F.when(F.col("k") % 5 != 0, F.array("path", F.lit("x,y"))).alias("sample_paths"), F.concat_ws(":", rule, F.lower("server"), F.lower("user")).alias("dedup_key"),
    )


def admin_entries(spark: SparkSession, d: str) -> DataFrame:
    e = audit_events(spark, d).withColumn("k", _k()).filter("action = 'accessed'")
    details = F.when(F.col("k") % 3 == 0, F.to_json(F.struct("server", F.lit("").alias("share"), F.lit("high").alias("priority"), F.lit(1).alias("other")))).when(F.col("k") % 3 == 1, "not json")
    return e.select(
        "id", "timestamp_utc", F.when(F.col("k") % 2 == 0, "Path.Update").otherwise("rule.update").alias("action"), F.when(F.col("k") % 2 == 0, "path").otherwise("rule").alias("entity_type"),
        F.col("k").cast("string").alias("entity_id"), F.col("user").alias("actor"), details.alias("details_json"),
    )


DERIVED = """, beats AS (SELECT server || '-' || share || (k % 8) AS agent_id, server, CASE WHEN k % 16 = 8 THEN 'degraded' ELSE 'running' END AS status, us, event_id AS last_record_id,
  CASE WHEN k % 3 = 0 THEN 'ok' END AS message, k * 20 AS pending FROM audit WHERE k % 4 = 0),
paths AS (SELECT DISTINCT server, share, k % 10 AS dir, '\\\\' || server || '\\' || share || '\\dir' || (k % 10) AS path, CASE (k % 10) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'planned' ELSE 'paused' END AS status,
  CASE (k % 10) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS priority FROM audit),
alerts AS (SELECT id, event_id, CASE action WHEN 'deleted' THEN 'mass-delete' ELSE 'permission-change' END AS rule, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' ELSE 'info' END AS severity,
  CASE WHEN k % 2 = 0 THEN 'open' ELSE 'acknowledged' END AS status, server, "user", k + 1 AS event_count, us, path, k, timestamp_utc FROM audit WHERE action IN ('deleted', 'permission_changed')),
admin AS (SELECT id, us, CASE WHEN k % 2 = 0 THEN 'Path.Update' ELSE 'rule.update' END AS action, CASE WHEN k % 2 = 0 THEN 'path' ELSE 'rule' END AS entity_type, "user" AS actor, k, server FROM audit WHERE action = 'accessed')"""
