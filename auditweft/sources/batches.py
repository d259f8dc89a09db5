"""The event table with a log of batches: each batch is stored once, old days go as whole folders.

``path``/events holds the rows by day and batch, ``path``/batches one row for each batch that is stored
whole. Readers see only batches of the log, so a batch that was cut short stays invisible until its
retry has overwritten what it left.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hydrate import cut
from .schemas import EVENT

TABLE = f"{EVENT}, event_date date, batch_id string"
LOG = "rows bigint, batch_id string"
#: Batches whose ids are sent to all executors; beyond it the log is joined by shuffle.
BROADCAST_BATCHES = 100_000


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders that match; they are as many as days, or as one day's batches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, rows) of the batches that are stored whole; none if nothing was stored yet."""
    if not _folders(spark, f"{path}/batches"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{path}/batches")


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """Store a batch of events unless the log has it; whether it was stored.

    A retry of a batch that was cut short replaces what that left, then the log names it. Two writers
    may store different batches at once. An empty batch is only logged; rows without a time share a folder.
    Ids are of letters, digits and ``. _ -``, since they name folders.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError(f"no folder name: {batch_id}")
    if stored_batches(spark, path).filter(F.col("batch_id") == batch_id).limit(1).count():
        return False
    for left in _folders(spark, f"{path}/events/event_date=*/batch_id={batch_id}"):
        _delete(spark, left)
    names = [f.strip().split(" ")[0] for f in EVENT.split(",")]
    rows = df.select(*names, F.to_date("timestamp_utc").alias("event_date"), F.lit(batch_id).alias("batch_id"))
    _replace(rows, f"{path}/events", ["event_date", "batch_id"])
    stored = spark.read.schema(TABLE).parquet(f"{path}/events").filter(F.col("batch_id") == batch_id)
    _replace(stored.agg(F.count("*").alias("rows")).select("rows", F.lit(batch_id).alias("batch_id")), f"{path}/batches", ["batch_id"])
    return True


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all batches of the log, with event_date and batch_id to prune by."""
    log = stored_batches(spark, path).select("batch_id")
    if not _folders(spark, f"{path}/events"):
        return spark.createDataFrame([], TABLE)
    few = log.limit(BROADCAST_BATCHES + 1).count() <= BROADCAST_BATCHES
    return spark.read.schema(TABLE).parquet(f"{path}/events").join(F.broadcast(log) if few else log, "batch_id", "left_semi")


def drop_expired(spark: SparkSession, path: str, days: int, as_of: str) -> int:
    """Delete events before ``as_of`` less max(1, days) days; how many rows of stored batches went.

    Days that lie before the border day go as folders, unread but for the count. Of the border day the rows
    that stay are checkpointed and replace those of their batches; batches without any left lose their
    folder. A run that stops in between leaves rows that the next one deletes. Rows without a time stay.
    """
    border = datetime.fromisoformat(as_of) - timedelta(days=max(1, days))
    limit = F.lit(border).cast("timestamp")
    day_of = {f: f.rsplit("event_date=", 1)[1] for f in _folders(spark, f"{path}/events/event_date=*")}
    dated = {f: date.fromisoformat(d) for f, d in day_of.items() if d[:1].isdigit()}
    table = read_events(spark, path).filter(F.col("event_date") <= F.lit(border.date()))
    gone = table.filter(F.col("timestamp_utc") < limit).count()
    for folder, day in dated.items():
        if day < border.date():
            _delete(spark, folder)
    here = f"{path}/events/event_date={border.date().isoformat()}"
    if here.rsplit("/", 1)[1] in {f.rsplit("/", 1)[1] for f in dated}:
        spark.catalog.refreshByPath(f"{path}/events")
        day = spark.read.schema(TABLE).parquet(f"{path}/events").filter(F.col("event_date") == F.lit(border.date()))
        touched = {r["batch_id"] for r in day.filter(F.col("timestamp_utc") < limit).select("batch_id").distinct().collect()}
        stay = cut(day.filter((F.col("timestamp_utc") >= limit) & F.col("batch_id").isin(*touched))) if touched else None
        if stay is not None:
            kept = {r["batch_id"] for r in stay.select("batch_id").distinct().collect()}
            _replace(stay, f"{path}/events", ["event_date", "batch_id"])
            for batch in touched - kept:
                _delete(spark, f"{here}/batch_id={batch}")
    spark.catalog.refreshByPath(f"{path}/events")
    return gone
