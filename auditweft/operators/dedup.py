"""One row per collected event: resends and doubled security rows go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of sources and actions.
SOURCES = {"usn-journal+security-log": 30, "windows-security-log": 20, "usn-journal": 10}
ACTIONS = {"created": 6, "renamed": 6, "deleted": 6, "permission_changed": 5, "modified": 4, "created_or_appended": 3, "changed": 2, "accessed": 1}


def dedup_collected(df: DataFrame) -> DataFrame:
    """Deletes and security creates: one per action, server, user, path, type and second; all others one
    per feed, volume, record and journal number. The row with the highest weight stays."""
    weigh = lambda values, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(c)), F.lit(0))
    second = F.lower("action").isin("deleted", "created_or_appended") & (F.lower("cursor_type") == "security")
    own = F.struct(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("action", "server", "user", "path", "object_type")), F.date_trunc("second", "timestamp_utc").cast("string").alias("at"))
    other = F.struct(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("cursor_type", "volume", "record_id", "usn")))
    key = F.when(second, F.xxhash64(F.lit(1), F.to_json(own))).otherwise(F.xxhash64(F.lit(2), F.to_json(other)))
    text = F.when(second, F.to_json(own)).otherwise(F.to_json(other))
    w = Window.partitionBy("_key", "_text").orderBy(F.desc("_weight"), F.desc(F.coalesce("record_id", F.lit(0))), F.desc("timestamp_utc"), F.coalesce("usn", F.lit(0)))
    marked = df.withColumn("_key", key).withColumn("_text", text).withColumn("_weight", weigh(SOURCES, "source") + weigh(ACTIONS, "action"))
    return marked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_key", "_text", "_weight", "_r")
