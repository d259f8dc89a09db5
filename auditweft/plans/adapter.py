"""Audit events and collected feeds derived from the driver's events table, for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping.
SHARES = ["Departamentos", "Financeiro", "RH", "Projetos"]
EXTENSIONS = [".locked", ".xlsx", ".docx", None, ".txt", ".tmp", ".pdf"]
PROCESSES = ["EXCEL.EXE", "explorer.exe", "robocopy.exe"]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def _mapped(spark: SparkSession, sf_dir: str, feeds: bool) -> DataFrame:
    e, k, i = raw_events(spark, sf_dir), F.col("k"), F.col("event_id")
    even = i % 2 == 0
    action = (
        F.when(F.col("event_type") == "click", "modified")
        .when(F.col("event_type") == "view", "accessed")
        .when(F.col("event_type") == "error", "deleted")
        .when(F.col("event_type") == "signup", "created_or_appended")
        .when(k % 2 == 0, "renamed")
        .otherwise("permission_changed")
    )
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    e = e.select("*", F.concat(F.lit("FS0"), (F.col("user_id") % 3 + 1).cast("string")).alias("server"), pick(SHARES, k % 4).alias("share"), pick(EXTENSIONS, k % 7).alias("extension"))
    if feeds:
        action = F.when(~even & (F.col("event_type") == "purchase"), F.when(i % 4 == 1, "renamed_old").otherwise("renamed_new")).otherwise(action)
    folder = F.when(~even & (i % 8 == 1), (k + 1) % 10).otherwise(k % 10) if feeds else k % 10
    root = F.concat(F.lit("\\\\"), "server", F.lit("\\"), "share", F.lit("\\dir"))
    path = F.concat(root, folder.cast("string"), F.lit("\\file"), k.cast("string"), F.coalesce("extension", F.lit("")))
    if feeds:
        path = F.when(even & (i % 16 == 2), F.concat(root, (k % 10).cast("string"))).otherwise(path)
    previous = F.when(action == "renamed", F.concat(root, (i % 10).cast("string"), F.lit("\\old"), k.cast("string"), F.coalesce("extension", F.lit(""))))
    user = F.concat(F.lit("EMPRESA\\user"), F.col("user_id").cast("string"))
    process = pick(PROCESSES, i % 3)
    return e.select(
        "event_id",
        "k",
        F.col("ts").cast("timestamp").alias("timestamp_utc"),
        "server",
        "share",
        path.alias("path"),
        previous.alias("previous_path"),
        F.when(F.col("extension").isNotNull(), "file").otherwise("unknown").alias("object_type"),
        action.alias("action"),
        (F.when(even, user).otherwise("UNKNOWN") if feeds else user).alias("user"),
        F.lit(None).cast("string").alias("sid"),
        F.concat(F.lit("WKS-"), (F.col("user_id") % 50).cast("string")).alias("source_host"),
        F.lit(None).cast("string").alias("source_ip"),
        (F.when(even, process).otherwise("fsutil.exe") if feeds else process).alias("process_name"),
        F.floor(F.col("value") * 1024).cast("bigint").alias("file_size_bytes"),
        "extension",
        F.lit("success").alias("result"),
        F.lit("info").alias("severity"),
        F.when(even, "windows-security-log").otherwise("usn-journal").alias("source"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, False).withColumn("id", F.col("event_id").cast("string")).drop("k", "event_id")


def collected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are the security feed, odd ones the journal."""
    c, i = _mapped(spark, sf_dir, True), F.col("event_id")
    even = i % 2 == 0
    return c.select(
        F.when(even, "security").otherwise("usn").alias("cursor_type"),
        F.when(even, i).alias("record_id"),
        F.when(~even, i).alias("usn"),
        F.when(~even, "D:").alias("volume"),
        *[x for x in c.columns if x not in ("event_id", "k")],
        F.when(~even, F.col("k").cast("string")).alias("file_reference_id"),
    )


def _sql(feeds: bool) -> str:
    ext = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXTENSIONS) if x) + " END"
    share = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SHARES)) + " END"
    process = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PROCESSES)) + " END"
    action = (
        "CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'accessed' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created_or_appended' "
        "ELSE CASE WHEN k % 2 = 0 THEN 'renamed' ELSE 'permission_changed' END END"
    )
    folder, path_case, user, proc = "k % 10", "{p}", "'EMPRESA\\user' || user_id", process
    if feeds:
        action = f"CASE WHEN event_id % 2 = 1 AND event_type = 'purchase' THEN CASE WHEN event_id % 4 = 1 THEN 'renamed_old' ELSE 'renamed_new' END ELSE {action} END"
        folder = "(CASE WHEN event_id % 2 = 1 AND event_id % 8 = 1 THEN (k + 1) % 10 ELSE k % 10 END)"
        path_case = "CASE WHEN event_id % 16 = 2 THEN root || (k % 10) ELSE {p} END"
        user, proc = f"CASE WHEN event_id % 2 = 0 THEN {user} ELSE 'UNKNOWN' END", f"CASE WHEN event_id % 2 = 0 THEN {process} ELSE 'fsutil.exe' END"
    path = path_case.format(p=f"root || {folder} || '\\file' || k || coalesce(extension, '')")
    return f"""e0 AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
e1 AS (SELECT *, 'FS0' || (user_id % 3 + 1) AS server, {share} AS share, {ext} AS extension FROM e0),
e2 AS (SELECT *, '\\\\' || server || '\\' || share || '\\dir' AS root, {action} AS action FROM e1),
e3 AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, k, ts AS timestamp_utc, epoch_us(ts) AS us, server, share, {path} AS path,
  CASE WHEN action = 'renamed' THEN root || (event_id % 10) || '\\old' || k || coalesce(extension, '') END AS previous_path,
  CASE WHEN extension IS NOT NULL THEN 'file' ELSE 'unknown' END AS object_type, action, {user} AS "user", 'WKS-' || (user_id % 50) AS source_host,
  {proc} AS process_name, CAST(floor(value * 1024) AS BIGINT) AS file_size_bytes, extension,
  CASE WHEN event_id % 2 = 0 THEN 'windows-security-log' ELSE 'usn-journal' END AS source FROM e2)"""


AUDIT = _sql(False) + ", audit AS (SELECT * FROM e3)"
COLLECTED = (
    _sql(True)
    + """, feed AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'security' ELSE 'usn' END AS cursor_type, CASE WHEN event_id % 2 = 0 THEN event_id END AS record_id,
  CASE WHEN event_id % 2 = 1 THEN event_id END AS usn, CASE WHEN event_id % 2 = 1 THEN 'D:' END AS volume, CASE WHEN event_id % 2 = 1 THEN CAST(k AS VARCHAR) END AS file_reference_id FROM e3)"""
)
