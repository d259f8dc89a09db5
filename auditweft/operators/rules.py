"""Detection rules as rows: normalisation, scope per event, static evaluation, samples of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank_to_null, clean, normalize_path
from ..sources.schemas import RULE

# Rule names, actions and extensions of the activity rule, day names, defaults.
ACTIVITY_ACTIONS = ["modified", "renamed", "deleted", "created", "created_or_appended"]
SUSPICIOUS_EXTENSIONS = [".lock", ".locked", ".crypt", ".crypted", ".crypto", ".encrypt", ".encrypted", ".enc", ".pay", ".ransom"]
VOLUME_RULES = ["mass-delete", "mass-rename", "possible-ransomware"]
RULE_NAMES = [*VOLUME_RULES, "permission-change"]
DAYS = {
    "sun": ["sun", "sunday", "dom", "domingo"],
    "mon": ["mon", "monday", "seg", "segunda", "segunda-feira"],
    "tue": ["tue", "tuesday", "ter", "terca", "terça", "terca-feira", "terça-feira"],
    "wed": ["wed", "wednesday", "qua", "quarta", "quarta-feira"],
    "thu": ["thu", "thursday", "qui", "quinta", "quinta-feira"],
    "fri": ["fri", "friday", "sex", "sexta", "sexta-feira"],
    "sat": ["sat", "saturday", "sab", "sáb", "sabado", "sábado"],
}
DEFAULT_RULES = [
    ("mass-delete", "critical", 50, None, None),
    ("mass-rename", "high", 100, None, None),
    ("possible-ransomware", "high", 250, 10, "critical"),
    ("permission-change", "high", None, None, None),
]


def default_rules(spark: SparkSession, thresholds: dict[str, tuple] | None = None) -> DataFrame:
    """The four rules as rows; ``thresholds`` replaces (threshold, secondary) by name."""
    rows = []
    for name, severity, t, t2, severity2 in DEFAULT_RULES:
        t, t2 = (thresholds or {}).get(name, (t, t2))
        rows.append((name, name.replace("-", " ").capitalize(), f"Activity matched rule {name}", True, severity, t, t2, severity2, *[None] * 11))
    return spark.createDataFrame(rows, RULE)


def _items(c: Column) -> Column:
    """Distinct lower-case items of a comma-separated list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;\n]"), lambda x: F.lower(clean(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def normalize_rules(df: DataFrame) -> DataFrame:
    """Rules with lower-case severities, list columns as arrays, and an array of errors."""
    canon = F.create_map(*[F.lit(x) for day, names in DAYS.items() for n in names for x in (n, day)])
    day_items = _items(F.col("active_days"))
    days = F.array_distinct(F.filter(F.transform(day_items, lambda x: F.element_at(canon, x)), lambda x: x.isNotNull()))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    bad_hour = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 23), F.lit(False))
    zone = blank_to_null(F.col("time_zone_id"))
    known_zone = zone.isNull() | zone.rlike(r"^(UTC|GMT|Z|[+-]\d{2}:\d{2}|(Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific|Etc)/[A-Za-z0-9_+\-/]+)$")
    needs = F.lower("rule").isin(VOLUME_RULES)
    checks = [
        (~F.lower("rule").isin(RULE_NAMES), "unknown rule"),
        (needs & positive("threshold").isNull(), "threshold is required"),
        ((F.lower("rule") == "possible-ransomware") & positive("secondary_threshold").isNull(), "secondary threshold is required"),
        (bad_hour("active_from_hour") | bad_hour("active_to_hour"), "hour is out of range"),
        (F.col("active_from_hour").isNull() != F.col("active_to_hour").isNull(), "both hours are required"),
        (F.size(days) < F.size(F.array_distinct(F.transform(day_items, lambda x: F.coalesce(F.element_at(canon, x), x)))), "unknown day"),
        (~known_zone, "unknown time zone"),
    ]
    errors = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull())
    out = df.select(
        F.lower(clean(F.col("rule"))).alias("rule"),
        "title",
        "description",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.lower(clean(F.col("severity"))).alias("severity"),
        positive("threshold").alias("threshold"),
        positive("secondary_threshold").alias("secondary_threshold"),
        F.lower(blank_to_null(F.col("secondary_severity"))).alias("secondary_severity"),
        *(F.lower(blank_to_null(F.col(c))).alias(c) for c in ("server_filter", "share_filter")),
        F.lower(normalize_path(blank_to_null(F.col("path_filter")))).alias("path_filter"),
        "active_from_hour",
        "active_to_hour",
        days.alias("active_days"),
        *(_items(F.col(c)).alias(c) for c in ("excluded_users", "excluded_hosts", "excluded_processes")),
        zone.alias("time_zone_id"),
        known_zone.alias("zone_known"),
        errors.alias("errors"),
    )
    return out


#: Rules that are sent to all executors; more aren't taken.
MAX_RULES = 10_000


def rule_applies(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the columns of every (normalised) rule whose scope they are in, prefixed ``r_``.

    Rules are a handful of rows and are sent to all executors. A window with equal hours never
    matches; a wrapped window's morning belongs to its own day. An unknown zone matches nothing, but
    only matters where hours or days are set.
    """
    n = rules.limit(MAX_RULES + 1).count()
    if n > MAX_RULES:
        raise ValueError("more rules than a dimension table holds")
    r = F.broadcast(rules.select(*(F.col(c).alias(f"r_{c}") for c in rules.columns)))
    timed = F.col("r_active_from_hour").isNotNull() | (F.size("r_active_days") > 0)
    local = F.from_utc_timestamp("timestamp_utc", F.when(F.col("r_zone_known"), F.coalesce("r_time_zone_id", F.lit("UTC"))).otherwise("UTC"))
    h, a, b = F.hour(local), F.col("r_active_from_hour"), F.col("r_active_to_hour")
    in_hours = a.isNull() | F.when(a < b, (h >= a) & (h < b)).when(a > b, (h >= a) | (h < b)).otherwise(False)
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(local))
    in_days = (F.size("r_active_days") == 0) | F.array_contains("r_active_days", day)
    out_of = lambda items, c: F.coalesce(F.array_contains(items, F.lower(clean(F.col(c)))), F.lit(False))
    scope = (
        ~out_of("r_excluded_users", "user")
        & ~out_of("r_excluded_hosts", "source_host")
        & ~out_of("r_excluded_processes", "process_name")
        & (F.col("r_server_filter").isNull() | (F.lower("server") == F.col("r_server_filter")))
        & (F.col("r_share_filter").isNull() | (F.lower("share") == F.col("r_share_filter")))
        & (F.col("r_path_filter").isNull() | F.startswith(F.lower(normalize_path(F.col("path"))), F.col("r_path_filter")))
        & (~timed | (F.col("r_zone_known") & in_hours & in_days))
    )
    return events.join(r, F.coalesce(scope, F.lit(False)))


def counted_action(rule: str = "r_rule", action: str = "action") -> Column:
    """Whether an event's action is one that the rule counts."""
    a = F.lower(action)
    return (
        F.when(F.col(rule) == "mass-delete", a == "deleted")
        .when(F.col(rule) == "mass-rename", a == "renamed")
        .when(F.col(rule) == "possible-ransomware", a.isin(ACTIVITY_ACTIONS))
        .when(F.col(rule) == "permission-change", a == "permission_changed")
        .otherwise(False)
    )


def suspicious(extension: str = "extension") -> Column:
    return F.coalesce(F.lower(extension).isin(SUSPICIOUS_EXTENSIONS), F.lit(False))


def reached(n: Column, n2: Column) -> Column:
    activity = F.col("r_rule") == "possible-ransomware"
    return F.when(activity, (n >= F.col("r_threshold")) | (n2 >= F.col("r_secondary_threshold"))).otherwise(n >= F.coalesce("r_threshold", F.lit(1)))


def raised_severity(n2: Column) -> Column:
    upper = (F.col("r_rule") == "possible-ransomware") & (n2 >= F.col("r_secondary_threshold"))
    return F.when(upper, F.coalesce("r_secondary_severity", "r_severity")).otherwise(F.col("r_severity"))


def evaluate_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of one set of events: one per (rule, server, user), but one per event for permissions."""
    hits = rule_applies(events, rules.filter("enabled")).filter(counted_action())
    each = F.when(F.col("r_rule") == "permission-change", F.col("id")).otherwise(F.lit(""))
    keys = ["r_rule", "r_severity", "r_secondary_severity", "r_threshold", "r_secondary_threshold"]
    n, n2 = F.col("event_count"), F.col("suspicious_count")
    alerts = (
        hits.groupBy(*keys, F.lower("server").alias("server_key"), F.lower("user").alias("user_key"), each.alias("event"))
        .agg(
            F.count("*").alias("event_count"),
            F.count_if(suspicious()).alias("suspicious_count"),
            F.min("timestamp_utc").alias("first_event_utc"),
            F.max("timestamp_utc").alias("last_event_utc"),
            F.min_by("server", F.struct("timestamp_utc", "id")).alias("server"),
            F.min_by("user", F.struct("timestamp_utc", "id")).alias("user"),
        )
        .filter(reached(n, n2))
    )
    return alerts.select(
        F.col("r_rule").alias("rule"),
        raised_severity(n2).alias("severity"),
        F.lit("open").alias("status"),
        "server",
        "user",
        "event_count",
        "first_event_utc",
        "last_event_utc",
        F.concat_ws(":", "r_rule", "server_key", "user_key").alias("dedup_key"),
    )


def sample_paths(alerts: DataFrame, events: DataFrame, rules: DataFrame, take: int = 10) -> DataFrame:
    """Alerts with sample_paths: the first distinct paths of their events, by time.

    Events meet the few alerts by (rule, server, user); per alert and path the first place is taken
    before ranking, so no alert's events are gathered whole.
    """
    hits = rule_applies(events, rules).filter(counted_action()).select(
        F.col("r_rule").alias("rule"), F.lower("server").alias("server_key"), F.lower("user").alias("user_key"), "timestamp_utc", F.col("id").alias("event_id"), "path"
    )
    keyed = alerts.withColumn("server_key", F.lower("server")).withColumn("user_key", F.lower("user"))
    own = keyed.select("rule", "server_key", "user_key", "first_event_utc", "last_event_utc").distinct()
    seen = own.join(hits, ["rule", "server_key", "user_key"]).filter(F.col("timestamp_utc").between(F.col("first_event_utc"), F.col("last_event_utc")))
    keys = ["rule", "server_key", "user_key", "first_event_utc", "last_event_utc"]
    first = seen.groupBy(*keys, F.lower("path").alias("path_key")).agg(F.min(F.struct("timestamp_utc", "event_id", "path")).alias("f"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("f"))).filter(F.col("r") <= take)
    lists = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "f.path"))), lambda x: x["path"]).alias("sample_paths"))
    return keyed.join(lists, keys, "left").drop("server_key", "user_key")
