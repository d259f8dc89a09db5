"""Administrative audit entries, retention, tagged clean-up, incremental slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import limit_of

DETAIL_KEYS = ["server", "share", "path", "status", "priority", "rule", "severity"]


def query_admin_audit(df: DataFrame, action: str | None = None, entity_type: str | None = None, take: int = 100) -> DataFrame:
    out = df
    for c, v in (("action", action), ("entity_type", entity_type)):
        if v and v.strip():
            out = out.filter(F.lower(c) == v.strip().lower())
    return out.orderBy(F.desc("timestamp_utc"), "id").limit(limit_of(take, 500, 100))


def audit_details(c: Column) -> Column:
    """``key: value`` of the known keys; '-' for nothing; the raw text if it isn't JSON or has none."""
    parts = F.concat_ws(
        " · ", *(F.when(F.coalesce(F.trim(F.get_json_object(c, f"$.{k}")), F.lit("")) != "", F.concat(F.lit(f"{k}: "), F.get_json_object(c, f"$.{k}"))) for k in DETAIL_KEYS)
    )
    return F.when(c.isNull() | (F.trim(c) == ""), "-").when(parts != "", parts).otherwise(c)


def apply_retention(df: DataFrame, ts_col: str, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with purged_count): rows before as_of less max(1, days) days go.

    With a table partitioned by day the condition prunes to whole partitions but one.
    """
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {max(1, days)} DAYS")
    return df.filter(F.col(ts_col) >= cut), df.agg(F.count_if(F.col(ts_col) < cut).alias("purged_count"))


def incremental_slice(df: DataFrame, cursor_col: str, last: int, max_events: int) -> DataFrame:
    """Rows beyond a cursor: the newest ``max_events``, in ascending order."""
    return df.filter(F.col(cursor_col) > last).orderBy(F.desc(cursor_col)).limit(max_events).orderBy(cursor_col)


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def purge_tagged(tables: dict[str, tuple[DataFrame, Column]], preview: int = 20) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per table (kept rows, newest tagged rows): tags are predicates such as equality, LIKE or a user list."""
    out = {}
    for name, (df, tagged) in tables.items():
        hit = F.coalesce(tagged, F.lit(False))
        order = [F.desc(c) for c in ("timestamp_utc", "created_utc") if c in df.columns] + [F.col("id")]
        out[name] = df.filter(~hit), df.filter(hit).orderBy(*order).limit(preview)
    return out


def purge_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """table_name, tagged_count of every table."""
    parts = [df.agg(F.count_if(F.coalesce(tagged, F.lit(False))).alias("tagged_count")).select(F.lit(name).alias("table_name"), "tagged_count") for name, (df, tagged) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
