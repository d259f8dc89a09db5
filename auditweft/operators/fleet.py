"""Agents and monitored paths: health, configuration, cursors, queue draining, root filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, is_blank, path_key, windows_volume

#: Most roots matched by a broadcast; beyond, events meet roots by the ancestors of their paths.
BROADCAST_ROOTS = 10_000


def latest_heartbeats(df: DataFrame) -> DataFrame:
    """The last heartbeat per agent (ids compare without case; equal times by content)."""
    row = F.struct(*df.columns)
    stamp = F.struct("last_heartbeat_utc", F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    return df.groupBy(F.lower("agent_id").alias("_key")).agg(F.max_by(row, stamp).alias("r")).select("r.*")


def agent_health(df: DataFrame, as_of: str, stale_min: int = 10, backlog: int = 1000) -> DataFrame:
    """Latest heartbeats with their health as status; a message is filled in only where none is set."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_heartbeat_utc")
    stale = F.col("last_heartbeat_utc").isNull() | (age > max(1, stale_min) * 60_000_000)
    late = F.col("pending_queue_events") >= max(1, backlog)
    minutes = F.floor(age / 60_000_000).cast("string")
    note = F.when(stale & F.col("last_heartbeat_utc").isNull(), "no heartbeat").when(stale, F.concat(F.lit("no heartbeat for "), minutes, F.lit(" min"))).when(
        late, F.concat(F.col("pending_queue_events").cast("string"), F.lit(" events queued"))
    )
    return (
        latest_heartbeats(df)
        .withColumn("message", F.coalesce("message", note))
        .withColumn("status", F.when(stale, "stale").when(late, "backlog").otherwise(F.col("status")))
        .orderBy("server", "agent_id")
    )


def agent_config(paths: DataFrame, no_share: str = "default") -> DataFrame:
    """Per server: distinct volumes, default share (``no_share`` if no path has one), and the active paths, in (server, share, path) order."""
    own = paths.filter(F.lower("status") == "active").withColumn("volume", windows_volume(F.col("path")))
    share = F.when(~is_blank(F.col("share")), F.struct(F.col("share").alias("share"), "path"))
    return own.groupBy("server").agg(
        F.array_sort(F.collect_set("volume")).alias("volumes"),
        F.coalesce(F.min(share)["share"], F.lit(no_share)).alias("default_share"),
        F.transform(F.array_sort(F.collect_list(F.struct("share", "path"))), lambda x: x["path"]).alias("paths"),
    )


def usn_base_path(paths: DataFrame) -> DataFrame:
    """server, volume, base_path: the shortest active root under each volume (ties by name)."""
    own = paths.filter(F.lower("status") == "active").withColumn("volume", windows_volume(F.col("path"))).filter("volume is not null")
    return own.groupBy("server", "volume").agg(F.min(F.struct(F.length("path"), "path"))["path"].alias("base_path"))


def advance_cursors(df: DataFrame) -> DataFrame:
    """One row: the highest record id, and the highest journal number per volume as a map."""
    per_volume = df.filter("usn is not null and volume is not null").groupBy("volume").agg(F.max("usn").alias("usn"))
    usn = per_volume.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("volume", "usn")))).alias("last_usn_by_volume"))
    return df.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("last_record_id")).join(usn)  # one row each


def filter_to_monitored(events: DataFrame, paths: DataFrame) -> DataFrame:
    """Events of a server whose path or previous path starts with one of its active roots.

    A prefix need not end at a separator. Without active roots everything stays.
    """
    roots = paths.filter(F.lower("status") == "active").select(F.lower(clean(F.col("server"))).alias("_server"), path_key(F.col("path")).alias("_root")).filter("_root <> ''").distinct()
    n = roots.limit(BROADCAST_ROOTS + 1).count()
    if n == 0:
        return events
    own = lambda c: F.startswith(path_key(F.col(c)), F.col("_root"))
    under = own("path") | F.coalesce(own("previous_path"), F.lit(False))
    if n <= BROADCAST_ROOTS:
        return events.join(F.broadcast(roots), (F.lower("server") == F.col("_server")) & under, "left_semi")
    # all prefixes that end as long as some root: few distinct lengths, then an equi-join
    lengths = [r["n"] for r in roots.select(F.length("_root").alias("n")).distinct().collect()]
    keys = F.array(*(F.substring(path_key(F.col(c)), 1, n) for c in ("path", "previous_path") for n in lengths))
    marked = events.withColumn("_row", F.monotonically_increasing_id())
    hit = marked.select("_row", F.lower("server").alias("_server"), F.explode(F.array_distinct(keys)).alias("_root")).join(roots, ["_server", "_root"], "left_semi").select("_row").distinct()
    return marked.join(hit, "_row", "left_semi").drop("_row")


def cursor_key(cursor_type: Column, volume: Column, usn: Column, record_id: Column) -> Column:
    usn_key = F.concat_ws(":", F.lit("usn"), F.lower(F.coalesce(volume, F.lit(""))), usn.cast("string"))
    return F.when(F.lower(cursor_type) == "usn", usn_key).otherwise(F.concat(F.lit("security:"), record_id.cast("string")))


def drain_queue(queued: DataFrame, sent: DataFrame, n: int) -> DataFrame:
    """The oldest n queued events, less those whose key was sent."""
    key = cursor_key(F.col("cursor_type"), F.col("volume"), F.col("usn"), F.col("record_id"))
    tied = [F.col("timestamp_utc"), key]
    oldest = queued.orderBy(*tied).limit(n).withColumn("cursor_key", key)
    done = sent.select(F.lower("cursor_key").alias("cursor_key")).distinct()
    return oldest.join(done, "cursor_key", "left_anti").orderBy("timestamp_utc", "cursor_key")


def list_monitored_paths(df: DataFrame, server: str | None = None, status: str | None = None) -> DataFrame:
    out = df
    if server and server.strip():
        out = out.filter(F.contains(F.lower("server"), F.lit(server.strip().lower())))
    if status and status.strip():
        out = out.filter(F.lower("status") == status.strip().lower())
    return out.orderBy("server", "share", "path")
