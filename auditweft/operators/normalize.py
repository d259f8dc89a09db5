"""Normalisation of raw audit events and of monitored paths, with rejects set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean, derive_extension, is_blank

REQUIRED = ["server", "share", "path", "object_type", "action", "user"]
OPTIONAL = ["previous_path", "sid", "source_host", "source_ip", "process_name"]
DEFAULTS = {"result": "success", "severity": "info", "source": "manual-ingest"}


def content_id(df: DataFrame) -> Column:
    """A repeatable id from an event's content."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns if c != "id"]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def normalize_events(df: DataFrame, ingest_ts: str | Column, with_id: bool = True) -> DataFrame:
    ts = F.lit(ingest_ts).cast("timestamp") if isinstance(ingest_ts, str) else ingest_ts
    out = df.select(
        F.coalesce("timestamp_utc", ts).alias("timestamp_utc"),
        *(F.lower(clean(F.col(c))).alias(c) if c in ("object_type", "action") else clean(F.col(c)).alias(c) for c in REQUIRED),
        *(blank_to_null(F.col(c)).alias(c) for c in OPTIONAL),
        "file_size_bytes",
        derive_extension(F.col("extension"), F.col("path")).alias("extension"),
        *(F.coalesce(blank_to_null(F.col(c)), F.lit(v)).alias(c) for c, v in DEFAULTS.items()),
        *([F.col("id").alias("id")] if "id" in df.columns else []),
    )
    return out if "id" in df.columns or not with_id else out.withColumn("id", content_id(out))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason): the first blank required field is the reason."""
    reason = F.coalesce(*(F.when(is_blank(F.col(c)), F.lit(f"{c} is required")) for c in REQUIRED))
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def normalize_monitored_paths(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): required server, share, path; known status and priority, with defaults."""

    def choice(c: str, known: list[str]) -> Column:
        v = F.lower(clean(F.col(c)))
        return F.when(v.isin(known), v).when(is_blank(F.col(c)), known[0])

    status, priority = choice("status", ["planned", "active", "paused", "retired"]), choice("priority", ["normal", "low", "high", "critical"])
    reason = F.coalesce(
        *(F.when(is_blank(F.col(c)), F.lit(f"{c} is required")) for c in ("server", "share", "path")),
        F.when(status.isNull(), F.lit("unknown status")),
        F.when(priority.isNull(), F.lit("unknown priority")),
    )
    marked = df.withColumn("reject_reason", reason)
    ok = marked.filter("reject_reason is null").drop("reject_reason")
    for c in ("server", "share", "path"):
        ok = ok.withColumn(c, clean(F.col(c)))
    return ok.withColumn("status", status).withColumn("priority", priority), marked.filter("reject_reason is not null")
