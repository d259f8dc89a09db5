"""Full paths of journal rows from file ids and parent ids, by pointer doubling."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import classify_transition, derive_extension, is_blank, parent_path


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without a setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """The rows from files in the shared folder: lineage ends there, each row is made once, and readers take the columns they need.

    Joins with them are shuffled and sorted. Repetitive rows take many times the size of their files, by
    which Spark would take them for small and send them to all executors through the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _known(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the latest row before this one, in journal order, that defines the id in ``key``.

    A deletion defines its id as unknown. Definitions and look-ups share one sorted pass per id.
    """
    cols = ["server", "volume"]
    define = rows.filter("file_id is not null").select(
        *cols, F.col("file_id").alias("_id"), "usn", F.lit(1).alias("_kind"), F.struct(F.when(F.col("action") != "deleted", F.col("_row")).alias("r")).alias("_def"), F.lit(None).cast("string").alias("_ask")
    )
    ask = rows.filter(F.col(key).isNotNull()).select(*cols, F.col(key).alias("_id"), "usn", F.lit(0).alias("_kind"), F.lit(None).cast("struct<r:string>").alias("_def"), F.col("_row").alias("_ask"))
    w = Window.partitionBy(*cols, "_id").orderBy("usn", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = define.union(ask).withColumn("_last", F.last("_def", ignorenulls=True).over(w)).filter("_ask is not null")
    return rows.join(seen.select(F.col("_ask").alias("_row"), F.col("_last.r").alias(name)), "_row", "left")


def hydrate_usn_paths(usn: DataFrame, base_path: str) -> DataFrame:
    """Adds path, previous_path, extension, object_type and the final action to decoded journal rows.

    A row's parent folder is the latest known path of its parent id earlier in the journal, else the
    base path. Deletions and old names take the known path of their own id. Chains of folders are
    resolved in rounds that double the resolved depth, never by walking a volume in one task.
    """
    rows = usn.withColumn("_row", F.md5(F.concat_ws("\x1f", F.lower("server"), F.lower(F.coalesce("volume", F.lit(""))), F.col("usn").cast("string"))))
    rows = _known(_known(rows, "parent_file_id", "_up"), "file_id", "_own")
    olds = Window.partitionBy("server", "volume", "file_id").orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_oldrow", F.last(F.when(F.col("action") == "renamed_old", F.col("_row")), ignorenulls=True).over(olds))
    rooted = F.col("file_name").rlike(r"^([A-Za-z]:|\\)")
    reuse = F.col("action").isin("deleted", "renamed_old") & F.col("_own").isNotNull()
    name = F.when(is_blank(F.col("file_name")), F.lit("\\")).otherwise(F.concat(F.lit("\\"), "file_name"))
    rows = cut(
        rows.withColumn("_to", F.when(reuse, F.col("_own")).when(rooted | is_blank(F.col("file_name")), None).otherwise(F.col("_up")))
        .withColumn("_tail", F.when(reuse, "").when(rooted, F.col("file_name")).otherwise(name))
        .withColumn("_rooted", ~reuse & F.coalesce(rooted, F.lit(False)))
    )
    chain = rows.select("_row", F.col("_to").alias("to"), F.col("_tail").alias("tail"), F.col("_rooted").alias("rooted"))
    while True:  # rows point to earlier rows only, so that every chain ends
        up = chain.select(F.col("_row").alias("to"), F.col("to").alias("to2"), F.col("tail").alias("tail2"), F.col("rooted").alias("rooted2"))
        chain = cut(
            chain.join(up, "to", "left").select(
                "_row", F.col("to2").alias("to"), F.concat(F.coalesce("tail2", F.lit("")), "tail").alias("tail"), F.coalesce("rooted2", "rooted").alias("rooted")
            )
        )
        if chain.filter("to is not null").limit(1).count() == 0:
            break
    base = F.lit(base_path.rstrip("\\"))
    paths = chain.select("_row", F.when(F.col("rooted"), F.col("tail")).otherwise(F.concat(base, "tail")).alias("path"))
    other = lambda key, name: paths.select(F.col("_row").alias(key), F.col("path").alias(name))
    out = rows.join(paths, "_row").join(other("_own", "_known"), "_own", "left").join(other("_oldrow", "_oldpath"), "_oldrow", "left")
    changed = F.col("action").isin("changed", "modified", "created") & F.col("_known").isNotNull() & (F.lower("_known") != F.lower("path"))
    moved = changed & (F.lower(parent_path(F.col("_known"))) != F.lower(parent_path(F.col("path"))))
    renamed = F.col("action") == "renamed_new"
    before = F.coalesce("_oldpath", "_known")
    action: Column = F.when(moved, "moved").when(renamed & before.isNotNull(), F.when(classify_transition(before, F.col("path")) == "moved", "moved").otherwise("renamed")).otherwise(F.col("action"))
    ext = derive_extension(F.lit(None).cast("string"), F.col("path"))
    return (
        out.withColumn("previous_path", F.when(changed, F.col("_known")).when(renamed, before))
        .withColumn("action", action)
        .withColumn("extension", ext)
        .withColumn("object_type", F.when(ext.isNotNull(), "file").otherwise("unknown"))
        .select(*usn.columns, "path", "previous_path", "extension", "object_type")
    )
