"""Sinks: the partitioned event table, CSV exports, notification documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank

# Export headers in their order.
EVENT_HEADER = "id timestamp_utc server share path previous_path object_type action user sid source_host source_ip process_name file_size_bytes extension result severity source".split()
ALERT_HEADER = "id rule severity status title description server user event_count first_event_utc last_event_utc created_utc acknowledged_utc sample_paths dedup_key".split()
ANOMALY_HEADER = "dimension name current_count baseline_average delta_percent".split()
COLORS = {"critical": "B42318", "high": "D92D20", "warning": "F79009"}


def append_events(df: DataFrame, path: str) -> None:
    """Append to the event table, one folder per day; the job's commit makes it all or nothing."""
    df.withColumn("event_date", F.to_date("timestamp_utc")).write.mode("append").partitionBy("event_date").parquet(path)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")


def csv_text(c: Column) -> Column:
    """A CSV field: null is empty; quotes only around quotes, commas and line breaks."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def _lines(df: DataFrame, header: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    values = [F.array_join(c, " | ") if kinds[c].startswith("array") else iso(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c) for c in header]
    return df.select(F.concat_ws(",", *(csv_text(v if isinstance(v, Column) else F.col(v)) for v in values)).alias("value"))


def export_events_csv(df: DataFrame) -> DataFrame:
    """One text line per event; write with the header EVENT_HEADER."""
    return _lines(df, EVENT_HEADER)


def export_alerts_csv(df: DataFrame) -> DataFrame:
    return _lines(df, ALERT_HEADER)


def export_anomalies_csv(df: DataFrame) -> DataFrame:
    return _lines(df, ANOMALY_HEADER)


def write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """Text files with the header as the first line of each."""
    lines.select(F.col("value").alias(",".join(header))).write.option("header", True).option("quote", "").option("quoteAll", False).option("escape", "").option("sep", "\u0001").csv(path)


def notification_payloads(alerts: DataFrame, fmt: str = "generic", min_severity: str = "high") -> DataFrame:
    """One JSON document per alert whose severity ranks at least ``min_severity``."""
    own = alerts.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    if fmt == "generic":
        fields = [c for c in ALERT_HEADER if c != "acknowledged_utc"]
        return own.select("id", F.to_json(F.struct(*fields)).alias("payload"))
    color = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv]), F.lower("severity")), F.lit("175CD3"))
    facts = [("Severity", "severity"), ("Rule", "rule"), ("Server", "server"), ("User", "user"), ("Events", "event_count"), ("Last event", "last_event_utc")]
    card = F.struct(
        F.lit("MessageCard").alias("@type"),
        F.lit("https://schema.org/extensions").alias("@context"),
        color.alias("themeColor"),
        F.col("title").alias("summary"),
        F.array(
            F.struct(
                F.col("title").alias("activityTitle"),
                F.col("description").alias("text"),
                F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in facts)).alias("facts"),
            )
        ).alias("sections"),
    )
    return own.select("id", F.to_json(card).alias("payload"))
