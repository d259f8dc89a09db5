"""Registered queries over alerts, agents, feeds, timelines, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admin, alerts, correlate, dedup, fleet, hydrate, normalize, reports, rules, timeline
from ..sources import batches, readers, writers
from ..sources.schemas import RULE, TABLES
from ..streaming import jobs
from .adapter import audit_events, collected_events
from .derived import DERIVED, admin_entries, alert_rows, heartbeats, monitored_paths
from .queries import _DETECT, ANOMALIES, DEDUP_MIN, RANGE, WINDOW_MIN, audit, feed, query, test_rules, us

AS_OF = "2024-01-30 12:00:00"


def derived(sql: str) -> str:
    return audit(DERIVED + " " + sql)


@query("latest_batch", audit("SELECT id, us FROM audit ORDER BY us DESC, id DESC LIMIT 25"))
def latest_batch(spark, d):
    return reports.latest_batch(audit_events(spark, d), 25).select("id", us("timestamp_utc", "us"))


@query("incremental_slice", audit("SELECT event_id, us FROM audit WHERE event_id > 100 ORDER BY event_id DESC LIMIT 300"))
def incremental_slice(spark, d):
    e = audit_events(spark, d).withColumn("event_id", F.col("id").cast("long"))
    return admin.incremental_slice(e, "event_id", 100, 300).select("event_id", us("timestamp_utc", "us"))


@query("query_alerts", derived("SELECT id, us FROM alerts WHERE severity = 'high' AND status = 'open' ORDER BY us DESC, id LIMIT 60"))
def query_alerts(spark, d):
    return alerts.query_alerts(alert_rows(spark, d), "HIGH", "Open", 60).select("id", us("created_utc", "us"))


@query("acknowledge_alerts", derived("SELECT id, CASE WHEN k % 7 = 0 THEN 'acknowledged' ELSE status END AS status, CASE WHEN k % 7 = 0 THEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') END AS at_us FROM alerts"))
def acknowledge_alerts(spark, d):
    a = alert_rows(spark, d)
    return alerts.acknowledge_alerts(a, a.filter("(event_count - 1) % 7 = 0").select("id"), AS_OF).select("id", "status", us("acknowledged_utc", "at_us"))


@query("notify_filter", derived("SELECT id, severity FROM alerts WHERE severity IN ('high', 'critical')"))
def notify_filter(spark, d):
    return alerts.notify_filter(alert_rows(spark, d), "High").select("id", "severity")


@query(
    "recent_alert_exists",
    derived("""SELECT n.id FROM alerts n WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM alerts s WHERE s.event_id % 2 = 0 AND s.rule = n.rule AND s.server = n.server AND s."user" = n."user" AND s.us >= n.us - 172800000000)"""),
)
def recent_alert_exists(spark, d):
    a = alert_rows(spark, d)
    n = F.col("id").cast("long") % 2
    new, stored = a.filter(n == 1), a.filter(n == 0)
    return alerts.recent_alert_exists(new, stored.select(*(F.col(c).alias(c) for c in stored.columns)), DEDUP_MIN).select("id")


@query(
    "alert_operations",
    derived(""", o AS (SELECT a.id AS alert_id, e.id, e.path, e.previous_path, a.path AS sample, a.k, row_number() OVER (PARTITION BY a.id ORDER BY e.us DESC, e.id) AS r, greatest(100, least(500, 4 * event_count)) AS quota
    FROM alerts a JOIN audit e ON e.server = a.server AND e."user" = a."user" AND e.us BETWEEN a.us - 86400000000 AND a.us + 86400000000)
    SELECT alert_id, id FROM o WHERE r <= quota AND (k % 5 = 0 OR starts_with(lower(path), lower(sample)) OR starts_with(lower(coalesce(previous_path, '')), lower(sample)))"""),
)
def alert_operations(spark, d):
    return alerts.alert_operations(alert_rows(spark, d), audit_events(spark, d), 1440).select("alert_id", "id")


@query("notification_payloads", derived("SELECT id, severity, rule, event_count FROM alerts WHERE severity IN ('high', 'critical')"))
def notification_payloads(spark, d):
    p = writers.notification_payloads(alert_rows(spark, d), "generic", "high")
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    return p.select("id", j("severity").alias("severity"), j("rule").alias("rule"), j("event_count").cast("int").alias("event_count"))


@query("notification_cards", derived("SELECT id, CASE severity WHEN 'critical' THEN 'B42318' ELSE 'D92D20' END AS color, 'Alert ' || rule AS summary, 6 AS facts, \"user\" AS fact_user FROM alerts WHERE severity IN ('high', 'critical')"))
def notification_cards(spark, d):
    p = writers.notification_payloads(alert_rows(spark, d), "teams", "high")
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    facts = F.json_array_length(j("sections[0].facts"))
    return p.select("id", j("themeColor").alias("color"), j("summary").alias("summary"), facts.alias("facts"), j("sections[0].facts[3].value").alias("fact_user"))


_LATEST = "SELECT * FROM beats QUALIFY row_number() OVER (PARTITION BY lower(agent_id) ORDER BY us DESC) = 1"


@query("latest_heartbeats", derived(f"SELECT agent_id, us, last_record_id, pending FROM ({_LATEST})"))
def latest_heartbeats(spark, d):
    return fleet.latest_heartbeats(heartbeats(spark, d)).select("agent_id", us("last_heartbeat_utc", "us"), "last_record_id", F.col("pending_queue_events").alias("pending"))


_HEALTH = f"""SELECT agent_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - us > 86400000000 THEN 'stale' WHEN pending >= 1000 THEN 'backlog' ELSE status END AS status, pending,
    coalesce(message, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - us > 86400000000 THEN 'no heartbeat for ' || CAST(floor((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - us) / 60000000) AS BIGINT) || ' min'
      WHEN pending >= 1000 THEN pending || ' events queued' END) AS message FROM ({_LATEST})"""


@query("agent_health", derived(f"SELECT agent_id, status, message FROM ({_HEALTH})"))
def agent_health(spark, d):
    return fleet.agent_health(heartbeats(spark, d), AS_OF, 1440, 1000).select("agent_id", "status", "message")


def _rooted(spark, d):
    """Monitored paths on volumes d:, D: and E:, and some on none."""
    dir_ = F.substring_index("path", "dir", -1).cast("int")
    return monitored_paths(spark, d).withColumn("path", F.concat(F.when(dir_ % 4 == 0, "d:").when(dir_ % 4 == 1, "D:").when(dir_ % 4 == 3, "E:").otherwise(""), "path"))


_ROOTED = """, rooted AS (SELECT server, share, status, upper(v) AS volume, v || path AS path FROM (SELECT *, CASE dir % 4 WHEN 0 THEN 'd:' WHEN 1 THEN 'D:' WHEN 3 THEN 'E:' ELSE '' END AS v FROM paths) WHERE status = 'active')"""


@query(
    "agent_config",
    derived(_ROOTED + """SELECT server, string_agg(DISTINCT volume, '|' ORDER BY volume) FILTER (volume <> '') AS volumes, min(share) AS default_share, string_agg(path, '|' ORDER BY share, path) AS paths FROM rooted GROUP BY server"""),
)
def agent_config(spark, d):
    return fleet.agent_config(_rooted(spark, d)).select("server", F.array_join("volumes", "|").alias("volumes"), "default_share", F.array_join("paths", "|").alias("paths"))


@query("usn_base_path", derived(_ROOTED + "SELECT server, volume, min_by(path, (length(path), path)) AS base_path FROM rooted WHERE volume <> '' GROUP BY ALL"))
def usn_base_path(spark, d):
    return fleet.usn_base_path(_rooted(spark, d))


@query("list_monitored_paths", derived("SELECT server, share, path, priority FROM paths WHERE server = 'FS02' AND status = 'planned'"))
def list_monitored_paths(spark, d):
    return fleet.list_monitored_paths(monitored_paths(spark, d), "fs02", "Planned").select("server", "share", "path", "priority")


@query(
    "normalize_monitored_paths",
    derived("""SELECT path, CASE WHEN dir = 3 THEN 'rejected' WHEN dir = 4 THEN 'planned' ELSE status END AS status, CASE WHEN dir = 3 THEN 'unknown status' ELSE CASE WHEN dir % 2 = 0 THEN 'normal' ELSE priority END END AS detail FROM paths"""),
)
def normalize_monitored_paths(spark, d):
    dir_ = F.substring_index("path", "dir", -1).cast("int")
    raw = monitored_paths(spark, d).withColumn("status", F.when(dir_ == 3, "gone").when(dir_ == 4, " ").otherwise(F.concat(F.lit(" "), F.upper("status"))))
    raw = raw.withColumn("priority", F.when(dir_ % 2 == 0, None).otherwise(F.col("priority"))).withColumn("path", F.concat(F.lit("\t"), "path"))
    ok, bad = normalize.normalize_monitored_paths(raw)
    return ok.select("path", "status", F.col("priority").alias("detail")).union(bad.select(F.ltrim(F.regexp_replace("path", "\t", "")), F.lit("rejected"), "reject_reason"))


@query("filter_to_monitored", derived("""SELECT id FROM audit a WHERE EXISTS (SELECT 1 FROM paths p WHERE p.status = 'active' AND p.server = a.server AND (starts_with(lower(a.path), lower(p.path)) OR starts_with(lower(a.previous_path), lower(p.path))))"""))
def filter_to_monitored(spark, d):
    return fleet.filter_to_monitored(audit_events(spark, d), monitored_paths(spark, d)).select("id")


@query(
    "advance_cursors",
    feed("SELECT max(record_id) AS last_record_id, max(usn) AS last_usn FROM feed"),
)
def advance_cursors(spark, d):
    return fleet.advance_cursors(collected_events(spark, d)).select("last_record_id", F.element_at("last_usn_by_volume", "D:").alias("last_usn"))


@query(
    "drain_queue",
    feed("""SELECT cursor_key FROM (SELECT CASE cursor_type WHEN 'usn' THEN 'usn:d::' || usn ELSE 'security:' || record_id END AS cursor_key, event_id FROM feed ORDER BY us, cursor_key LIMIT 400) WHERE event_id % 5 <> 0"""),
)
def drain_queue(spark, d):
    q = collected_events(spark, d)
    key = fleet.cursor_key(F.col("cursor_type"), F.col("volume"), F.col("usn"), F.col("record_id"))
    sent = q.filter(F.coalesce("record_id", "usn") % 5 == 0).select(F.upper(key).alias("cursor_key"))
    return fleet.drain_queue(q, sent, 400).select("cursor_key")


@query("merge_feeds", feed("SELECT cursor_type, count(*) AS n, count(record_id) AS records, count(usn) AS usns FROM feed GROUP BY 1"))
def merge_feeds(spark, d):
    c = collected_events(spark, d)
    both = admin.merge_feeds(c.filter("cursor_type = 'security'").drop("usn", "volume"), c.filter("cursor_type = 'usn'").drop("record_id"))
    return both.groupBy("cursor_type").agg(F.count("*").alias("n"), F.count("record_id").alias("records"), F.count("usn").alias("usns"))


@query(
    "dedup_collected",
    feed("""SELECT cursor_type, coalesce(record_id, usn) AS number, "user" FROM feed QUALIFY row_number() OVER (PARTITION BY CASE WHEN cursor_type = 'security' AND action IN ('deleted', 'created_or_appended')
    THEN action || server || "user" || path || object_type || CAST(date_trunc('second', timestamp_utc) AS VARCHAR) ELSE cursor_type || event_id END ORDER BY coalesce(record_id, 0) DESC, us DESC) = 1"""),
)
def dedup_collected(spark, d):
    c = collected_events(spark, d)
    return dedup.dedup_collected(c.unionByName(c.filter("action = 'deleted' or usn % 3 = 0"))).select("cursor_type", F.coalesce("record_id", "usn").alias("number"), "user")


_SCORE = """CASE WHEN lower(u.{a}) = lower(s.{b}) THEN 100 WHEN regexp_extract(lower(u.{a}), '([^\\\\]*)$', 1) = regexp_extract(lower(s.{b}), '([^\\\\]*)$', 1) THEN 60
  WHEN contains(lower(u.{a}), lower(s.{b})) OR contains(lower(s.{b}), lower(u.{a})) THEN 30 ELSE 0 END"""
_PAIRS = f""", pairs AS (SELECT u.usn, s.record_id, abs(u.us - s.us) AS gap, u.path AS upath, s.path AS spath, s."user" AS suser, s.process_name AS sprocess, s.source_host AS shost, s.action AS saction,
  greatest({_SCORE.format(a='path', b='path')}, {_SCORE.format(a='path', b='previous_path')}) AS score
  FROM feed u JOIN feed s ON u.cursor_type = 'usn' AND s.cursor_type = 'security' AND u.server = s.server AND abs(u.us - s.us) <= 3600000000)"""


def _feeds(spark, d):
    c = hydrate.cut(correlate.with_row(collected_events(spark, d)))
    return c.filter("cursor_type = 'usn'"), c.filter("cursor_type = 'security'")


@query(
    "correlate_feeds",
    feed(_PAIRS + """, best AS (SELECT * FROM pairs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY usn ORDER BY score DESC, gap, record_id) = 1)
    SELECT f.usn, coalesce(b.suser, f."user") AS "user", CASE WHEN b.usn IS NOT NULL THEN b.sprocess ELSE f.process_name END AS process_name, CASE WHEN b.usn IS NOT NULL THEN 'usn-journal+security-log' ELSE f.source END AS source
    FROM feed f LEFT JOIN best b ON b.usn = f.usn WHERE f.cursor_type = 'usn'"""),
)
def correlate_feeds(spark, d):
    usn, security = _feeds(spark, d)
    return correlate.correlate_feeds(usn, security, 3600).select("usn", "user", "process_name", "source")


@query(
    "suppress_matched_security",
    feed(_PAIRS + """SELECT record_id, action FROM feed f WHERE cursor_type = 'security' AND record_id NOT IN (SELECT record_id FROM pairs WHERE score > 0
    AND saction IN ('accessed', 'created_or_appended', 'modified', 'deleted', 'renamed') AND (starts_with(lower(upath), lower(spath)) OR starts_with(lower(spath), lower(upath))))"""),
)
def suppress_matched_security(spark, d):
    usn, security = _feeds(spark, d)
    return correlate.suppress_matched_security(usn, security, 3600).select("record_id", "action")


_RENAMES = """, j AS (SELECT *, lower(path) AS key FROM feed WHERE cursor_type = 'usn'),
m AS (SELECT *, action = 'renamed_old' AS old, max(CASE WHEN action = 'renamed_old' THEN usn END) OVER ahead AS old_before, max(CASE WHEN action = 'renamed_new' THEN usn END) OVER ahead AS new_before,
  min(CASE WHEN action = 'renamed_old' THEN usn END) OVER behind AS old_next, min(CASE WHEN action = 'renamed_new' THEN usn END) OVER behind AS new_next FROM j WHERE action IN ('renamed_old', 'renamed_new')
  WINDOW ahead AS (PARTITION BY server, share, k ORDER BY usn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), behind AS (PARTITION BY server, share, k ORDER BY usn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT *, old AND old_before IS NULL AND new_before IS NOT NULL AS taken FROM m),
p AS (SELECT coalesce(new_next, new_before) AS new_usn, usn AS old_usn, usn AS made FROM t WHERE old AND NOT taken
  UNION ALL SELECT t.usn, coalesce(t.old_before, t.old_next), t.usn FROM t LEFT JOIN t o ON o.usn = t.old_before WHERE NOT t.old AND NOT (o.usn IS NOT NULL AND NOT o.taken AND (t.new_before IS NULL OR t.new_before < t.old_before))),
pairs AS (SELECT p.made, n.*, o.path AS old_path, o.key AS old_key, o.usn AS old_usn FROM p JOIN j n ON n.usn = p.new_usn JOIN j o ON o.usn = p.old_usn),
noise AS (SELECT * FROM j WHERE action IN ('changed', 'modified', 'created', 'created_or_appended')),
gone AS (SELECT z.usn FROM noise z JOIN pairs q ON z.server = q.server AND z.share = q.share AND z.k = q.k AND abs(z.us - q.us) <= 3600000000 AND z.usn > q.made
  UNION SELECT z.usn FROM noise z JOIN (SELECT server, share, us, made, unnest([key, old_key]) AS spot FROM pairs) q ON z.server = q.server AND z.share = q.share AND z.key = q.spot AND abs(z.us - q.us) <= 3600000000 AND z.usn > q.made)"""


@query(
    "pair_renames",
    feed(_RENAMES + """SELECT usn, path, old_path AS previous_path, CASE WHEN regexp_replace(key, '\\[^\\]*$', '') <> regexp_replace(old_key, '\\[^\\]*$', '') THEN 'moved' ELSE 'renamed' END AS action, object_type FROM pairs
    UNION ALL SELECT usn, path, previous_path, CASE WHEN action IN ('renamed_old', 'renamed_new') THEN 'renamed' ELSE action END, object_type FROM j
    WHERE usn NOT IN (SELECT usn FROM gone) AND usn NOT IN (SELECT usn FROM pairs UNION SELECT old_usn FROM pairs)"""),
)
def pair_renames(spark, d):
    usn, _ = _feeds(spark, d)
    return correlate.apply_transitions(usn, correlate.transitions(usn, 3600).filter("how = 'pair'"), 3600).select("usn", "path", "previous_path", "action", "object_type")


@query(
    "drop_rename_noise",
    feed(_RENAMES + "SELECT usn, action FROM j WHERE usn NOT IN (SELECT usn FROM gone) AND usn NOT IN (SELECT usn FROM pairs UNION SELECT old_usn FROM pairs)"),
)
def drop_rename_noise(spark, d):
    usn, _ = _feeds(spark, d)
    return correlate.drop_rename_noise(usn, correlate.transitions(usn, 3600).filter("how = 'pair'"), 3600).select("usn", "action")


@query("infer_renames")
def infer_renames(spark, d):
    usn, _ = _feeds(spark, d)
    return correlate.apply_transitions(usn, correlate.transitions(usn, 3600).filter("how = 'inferred'"), 3600).select("usn", "path", "previous_path", "action", "object_type")


@query("correlate")
def correlate_all(spark, d):
    return correlate.correlate(collected_events(spark, d), 3600).select("cursor_type", "record_id", "usn", "path", "previous_path", "action", "user", "source")


@query("finalize_actions", audit("""SELECT id, CASE WHEN event_id % 4 = 0 AND action = 'modified' THEN 'created' ELSE action END AS action FROM audit"""))
def finalize_actions(spark, d):
    e = audit_events(spark, d)
    named = e.withColumn("path", F.when(F.col("id").cast("long") % 4 == 0, "\\\\FS01\\x\\New Text Document.txt").otherwise(F.col("path")))
    return correlate.finalize_actions(named).select("id", "action")


def _journal(spark, d):
    """Folders and files from the events: chains of ten ids, each the parent of the next; 200 new ids every 2000 events."""
    e = audit_events(spark, d).withColumn("n", F.col("id").cast("long"))
    node = F.col("n") % 200 + F.floor(F.col("n") / 2000) * 200
    return e.select(
        F.col("n").alias("usn"), F.lit("D:").alias("volume"), "timestamp_utc", "server", "share", F.lit("created").alias("action"), F.lit("FILE_CREATE").alias("reason"),
        F.concat(F.lit("f"), node.cast("string")).alias("file_id"), F.when(node % 10 > 0, F.concat(F.lit("f"), (node - 1).cast("string"))).alias("parent_file_id"),
        F.concat(F.lit("n"), node.cast("string")).alias("file_name"),
    )


@query(
    "hydrate_usn_paths",
    audit(""", j AS (SELECT event_id AS usn, server, event_id % 200 + event_id // 2000 * 200 AS node FROM audit),
    up AS (SELECT c.usn, p.usn AS up, c.node FROM j c ASOF LEFT JOIN j p ON p.server = c.server AND p.node = c.node - 1 AND p.usn < c.usn),
    r AS (SELECT usn, CASE WHEN node % 10 > 0 THEN up END AS ptr, '\\n' || node AS tail FROM up UNION ALL SELECT r.usn, CASE WHEN u.node % 10 > 0 THEN u.up END, '\\n' || u.node || r.tail FROM r JOIN up u ON u.usn = r.ptr)
    SELECT usn, 'D:\\base' || tail AS path FROM r WHERE ptr IS NULL"""),
)
def hydrate_usn_paths(spark, d):
    return hydrate.hydrate_usn_paths(_journal(spark, d), "D:\\base").select("usn", "path")


@query(
    "operational_posture",
    derived(ANOMALIES.rstrip() + f""" SELECT *, CASE WHEN critical_open > 0 OR highest_anomaly >= 150 THEN 'high' WHEN open_alerts > 0 OR agents_attention > 0 OR highest_anomaly >= 60 THEN 'watch' ELSE 'stable' END AS posture FROM
    (SELECT count(*) FILTER (status = 'open') AS open_alerts, count(*) FILTER (status = 'open' AND severity = 'critical') AS critical_open FROM alerts),
    (SELECT count(*) FILTER (status <> 'running' OR pending > 0) AS agents_attention FROM ({_HEALTH})), (SELECT max(delta_percent) AS highest_anomaly FROM anomalies)"""),
)
def operational_posture(spark, d):
    anomalies = reports.baseline_anomalies(audit_events(spark, d), *RANGE, windows=7, take=8)
    return reports.operational_posture(alert_rows(spark, d), fleet.agent_health(heartbeats(spark, d), AS_OF, 1440, 1000), anomalies)


@query(
    "fleet_counts",
    derived(f"""SELECT * FROM (SELECT count(*) FILTER (status = 'stale') AS stale_agents, count(*) FILTER (status = 'backlog') AS backlog_agents,
      count(*) FILTER (status NOT IN ('running', 'stale', 'backlog')) AS degraded_agents, count(*) FILTER (pending > 0) AS queued_agents FROM ({_HEALTH})),
    (SELECT count(*) FILTER (status = 'active') AS active_paths, count(*) FILTER (priority IN ('high', 'critical')) AS priority_paths FROM paths), (SELECT CAST(4 AS BIGINT) AS enabled_rules), (SELECT count(DISTINCT lower(actor)) AS actors FROM admin)"""),
)
def fleet_counts(spark, d):
    agents = fleet.agent_health(heartbeats(spark, d), AS_OF, 1440, 1000)
    return reports.fleet_counts(agents, monitored_paths(spark, d), test_rules(spark), admin_entries(spark, d))


@query("retention", audit("SELECT server, count(*) FILTER (us >= epoch_us(TIMESTAMP '2024-01-20 12:00:00')) AS kept, (SELECT count(*) FROM audit WHERE us < epoch_us(TIMESTAMP '2024-01-20 12:00:00')) AS purged_count FROM audit GROUP BY server"))
def retention(spark, d):
    kept, purged = admin.apply_retention(audit_events(spark, d), "timestamp_utc", 10, AS_OF)
    return kept.groupBy("server").agg(F.count("*").alias("kept")).join(purged)  # one row of counts


def _tagged(spark, d):
    e, a = audit_events(spark, d), alert_rows(spark, d)
    users = [f"EMPRESA\\user{i}" for i in range(5)]
    return {"events": (e, F.col("user").isin(users) | F.col("path").like("%dir3%")), "alerts": (a, F.col("rule") == "permission-change"), "admin": (admin_entries(spark, d), F.col("action").like("rule%"))}


@query(
    "purge_tagged",
    derived("""SELECT 'events' AS table_name, count(*) FILTER ("user" IN ('EMPRESA\\user0', 'EMPRESA\\user1', 'EMPRESA\\user2', 'EMPRESA\\user3', 'EMPRESA\\user4') OR path LIKE '%dir3%') AS tagged_count FROM audit
    UNION ALL SELECT 'alerts', count(*) FILTER (rule = 'permission-change') FROM alerts UNION ALL SELECT 'admin', count(*) FILTER (action LIKE 'rule%') FROM admin"""),
)
def purge_tagged(spark, d):
    return admin.purge_counts(_tagged(spark, d))


@query("purge_kept", derived("SELECT id FROM alerts WHERE rule <> 'permission-change'"))
def purge_kept(spark, d):
    return admin.purge_tagged(_tagged(spark, d))["alerts"][0].select("id")


@query("purge_preview", derived("SELECT id, us FROM alerts WHERE rule = 'permission-change' ORDER BY us DESC, id LIMIT 20"))
def purge_preview(spark, d):
    return admin.purge_tagged(_tagged(spark, d))["alerts"][1].select("id", us("created_utc", "us"))


@query("admin_audit", derived("SELECT id, us, actor FROM admin WHERE lower(action) = 'path.update' AND entity_type = 'path' ORDER BY us DESC, id LIMIT 40"))
def admin_audit(spark, d):
    return admin.query_admin_audit(admin_entries(spark, d), "path.update", "PATH", 40).select("id", us("timestamp_utc", "us"), "actor")


@query("audit_details", derived("SELECT id, CASE k % 3 WHEN 0 THEN 'server: ' || server || ' · priority: high' WHEN 1 THEN 'not json' ELSE '-' END AS details FROM admin"))
def audit_details(spark, d):
    return admin_entries(spark, d).select("id", admin.audit_details(F.col("details_json")).alias("details"))


@query(
    "timeline_dedup",
    audit(""", t AS (SELECT id, event_id AS n, us, us // 1000000 AS s, "user", action, path, previous_path, CASE WHEN event_id % 5 = 0 THEN source || '+security-log' ELSE source END AS source FROM audit),
    x AS (SELECT * EXCLUDE (n) FROM t UNION ALL SELECT 'a' || id, s * 1000000 + 999999, s, "user", action, path, coalesce(previous_path, ''), source FROM t WHERE n % 3 > 0
      UNION ALL SELECT 'z' || id, s * 1000000 + CASE WHEN n % 2 = 0 THEN 0 ELSE 999999 END, s, "user", action, path, previous_path, source FROM t)
    SELECT id, source, CASE WHEN contains(source, 'usn-journal+security-log') THEN 30 WHEN contains(source, 'usn-journal') THEN 20 ELSE 10 END
      + CASE WHEN action IN ('renamed', 'moved') THEN 30 WHEN action = 'deleted' THEN 20 WHEN action IN ('created', 'created_or_appended') THEN 15 ELSE 5 END AS weight FROM x
    QUALIFY row_number() OVER (PARTITION BY "user", source, action, path, coalesce(previous_path, ''), s ORDER BY us DESC, id) = 1"""),
)
def timeline_dedup(spark, d):
    """Copies of each row earlier, as late and later in its second; weights are shown, as one key's rows all weigh the same."""
    n, micros = F.col("id").cast("long"), F.unix_micros("timestamp_utc")
    second = micros - micros % 1_000_000
    e = audit_events(spark, d)
    e = e.withColumn("source", F.when(n % 5 == 0, F.concat("source", F.lit("+security-log"))).otherwise(F.col("source")))
    end = e.filter(n % 3 > 0).withColumns({"timestamp_utc": F.timestamp_micros(second + 999_999), "previous_path": F.coalesce("previous_path", F.lit("")), "id": F.concat(F.lit("a"), "id")})
    edge = e.withColumns({"timestamp_utc": F.timestamp_micros(second + F.when(n % 2 == 0, 0).otherwise(999_999)), "id": F.concat(F.lit("z"), "id")})
    return timeline.timeline_dedup(e.unionByName(end).unionByName(edge)).select("id", "source", timeline.weight().alias("weight"))


@query(
    "semantic_key",
    audit("""SELECT id, "user" || '|' || CASE WHEN contains(source, 'usn-journal') THEN 'usn' ELSE source END || '|' || CASE WHEN action = 'modified' THEN 'changed' ELSE action END || '|' || lower(path) || '|' || lower(coalesce(previous_path, '')) || '|' || strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS k FROM audit"""),
)
def semantic_key(spark, d):
    return audit_events(spark, d).select("id", timeline.semantic_key().alias("k"))


_UNKNOWN = """, t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'UNKNOWN' ELSE "user" END AS who, lower(path) AS p, lower(previous_path) AS q FROM audit),
pp AS (SELECT id, server, share, us, who, x AS p, regexp_replace(x, '\\\\[^\\\\]*$', '') AS parent FROM t, unnest([p, q]) u(x) WHERE x IS NOT NULL),
near AS (SELECT a.id, b.who, abs(a.us - b.us) AS gap, b.us, b.id AS other FROM pp a JOIN pp b ON a.who = 'UNKNOWN' AND b.who <> 'UNKNOWN' AND a.server = b.server AND a.share = b.share AND abs(a.us - b.us) <= 7200000000
  AND (a.p = b.p OR starts_with(a.p, b.p || '\\') OR starts_with(b.p, a.p || '\\') OR a.parent = b.parent))"""


@query("resolve_unknown_users", audit(_UNKNOWN + """SELECT t.id, coalesce(n.who, t.who) AS "user" FROM t LEFT JOIN (SELECT id, min_by(who, (gap, -us, other)) AS who FROM near GROUP BY id) n USING (id)"""))
def resolve_unknown_users(spark, d):
    e = audit_events(spark, d)
    return timeline.resolve_unknown_users(e.withColumn("user", F.when(F.col("id").cast("long") % 3 == 0, "UNKNOWN").otherwise(F.col("user"))), 7200).select("id", "user")


_MOVED = """, t AS (SELECT id, us, CASE WHEN action = 'permission_changed' THEN 'moved' WHEN action = 'accessed' THEN 'changed' ELSE action END AS a, lower(path) AS p,
  lower(CASE WHEN action = 'permission_changed' THEN root0 || (event_id % 10) || '\\file' || k || coalesce(extension, '') ELSE previous_path END) AS q, contains(regexp_extract(path, '([^\\\\]*)$', 1), '.') AS dot,
  coalesce(extension, '') = '.tmp' AS transient FROM (SELECT *, '\\\\' || server || '\\' || share || '\\dir' AS root0 FROM audit)),
v AS (SELECT *, regexp_replace(p, '\\\\[^\\\\]*$', '') AS pp FROM t WHERE NOT transient)"""


@query(
    "suppress_echoes",
    audit(_MOVED + """SELECT e.id, e.a AS action FROM v e WHERE NOT (e.a = 'deleted' AND EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a IN ('renamed', 'moved') AND c.q = e.p AND abs(c.us - e.us) <= 3600000000))
    AND NOT (e.a IN ('changed', 'modified') AND NOT e.dot AND EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a = 'moved' AND c.pp = e.p AND abs(c.us - e.us) <= 7200000000))
    AND NOT (e.a IN ('created', 'created_or_appended') AND EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a IN ('renamed', 'moved') AND c.p = e.p AND abs(c.us - e.us) <= 3600000000))
    AND NOT (e.a IN ('changed', 'modified') AND EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a IN ('renamed', 'moved', 'created', 'created_or_appended', 'deleted') AND (c.p = e.p OR c.q = e.p) AND abs(c.us - e.us) <= 3600000000))"""),
)
def suppress_echoes(spark, d):
    e = audit_events(spark, d)
    n = F.col("id").cast("long")
    moved = F.col("action") == "permission_changed"
    k = F.regexp_extract("path", r"file(\d+)", 1)
    before = F.concat(F.lit("\\\\"), "server", F.lit("\\"), "share", F.lit("\\dir"), (n % 10).cast("string"), F.lit("\\file"), k, F.coalesce("extension", F.lit("")))
    e = e.withColumn("previous_path", F.when(moved, before).otherwise(F.col("previous_path")))
    e = e.withColumn("action", F.when(moved, "moved").when(F.col("action") == "accessed", "changed").otherwise(F.col("action")))
    return timeline.suppress_echoes(e, 240.0).select("id", "action")


@query(
    "suppress_provisional_echoes",
    audit(""", t0 AS (SELECT id, event_id AS n, us, action, '\\\\' || server || '\\' || share || '\\dir' || (k % 4) AS root, '\\f' || (k % 4) || '.txt' AS leaf FROM audit),
    t1 AS (SELECT id, us, CASE action WHEN 'permission_changed' THEN 'moved' WHEN 'accessed' THEN 'changed' ELSE action END AS a, lower(root || CASE
        WHEN action = 'created_or_appended' AND n % 3 = 0 OR action = 'renamed' AND n % 6 = 1 THEN '\\New Text Document.txt' WHEN action = 'created_or_appended' AND n % 3 = 1 OR action = 'renamed' AND n % 6 = 3 THEN '\\New Folder'
        WHEN action = 'deleted' AND n % 2 = 0 THEN '\\sub' || leaf WHEN action = 'accessed' AND n % 5 = 0 THEN '' ELSE leaf END) AS p,
      lower(root || CASE WHEN action = 'renamed' THEN CASE WHEN n % 3 = 0 THEN '\\New Text Document.txt' ELSE '\\old.txt' END WHEN action = 'permission_changed' THEN '\\sub' || leaf END) AS q FROM t0),
    v AS (SELECT *, regexp_replace(p, '\\\\[^\\\\]*$', '') AS pp, regexp_replace(q, '\\\\[^\\\\]*$', '') AS qp, contains(regexp_extract(p, '([^\\\\]*)$', 1), '.') AS dot, regexp_matches(p, '\\\\(new text document.txt|new folder)$') AS prov,
      coalesce(regexp_matches(q, '\\\\new text document.txt$'), false) AS qtext, regexp_matches(p, '\\\\new text document.txt$') AS text FROM t1)
    SELECT e.id, e.a AS action FROM v e WHERE NOT (e.a = 'deleted' AND EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a IN ('renamed', 'moved') AND c.q = e.p AND abs(c.us - e.us) <= 3600000000))
    AND NOT (e.a = 'moved' AND starts_with(e.qp, e.pp || '\\') AND EXISTS (SELECT 1 FROM v c WHERE c.a = 'deleted' AND c.p = e.q AND abs(c.us - e.us) <= 7200000000)
      AND NOT EXISTS (SELECT 1 FROM v c WHERE c.id <> e.id AND c.a <> 'deleted' AND c.p = e.p AND abs(c.us - e.us) <= 1920000000))
    AND NOT (e.a = 'changed' AND NOT e.dot AND EXISTS (SELECT 1 FROM v c WHERE c.a = 'moved' AND c.pp = e.p AND abs(c.us - e.us) <= 7200000000))
    AND NOT (e.a = 'created_or_appended' AND e.prov AND EXISTS (SELECT 1 FROM v c WHERE c.a IN ('renamed', 'moved') AND c.pp = e.pp AND (NOT c.prov OR e.text AND c.qtext) AND abs(c.us - e.us) <= 10800000000))
    AND NOT (e.a IN ('renamed', 'moved') AND e.qtext AND EXISTS (SELECT 1 FROM v c WHERE c.a = 'created_or_appended' AND c.p = e.p AND abs(c.us - e.us) <= 3600000000))
    AND NOT (e.a = 'created_or_appended' AND EXISTS (SELECT 1 FROM v c WHERE c.a IN ('renamed', 'moved') AND c.p = e.p AND abs(c.us - e.us) <= 3600000000))
    AND NOT (e.a IN ('changed', 'modified') AND EXISTS (SELECT 1 FROM v c WHERE c.a IN ('renamed', 'moved', 'created_or_appended', 'deleted') AND (c.p = e.p OR c.q = e.p) AND abs(c.us - e.us) <= 3600000000))"""),
)
def suppress_provisional_echoes(spark, d):
    """All eight echo rules, on few busy folders with new documents, moves out of folders below and folder changes."""
    e = audit_events(spark, d)
    n, act = F.col("id").cast("long"), lambda name: F.col("action") == name
    k = (F.regexp_extract("path", r"file(\d+)", 1).cast("int") % 4).cast("string")
    root, leaf = F.concat(F.lit("\\\\"), "server", F.lit("\\"), "share", F.lit("\\dir"), k), F.concat(F.lit("\\f"), k, F.lit(".txt"))
    text, folder, sub = F.lit("\\New Text Document.txt"), F.lit("\\New Folder"), F.concat(F.lit("\\sub"), leaf)
    end = F.when(act("created_or_appended") & (n % 3 == 0) | act("renamed") & (n % 6 == 1), text).when(act("created_or_appended") & (n % 3 == 1) | act("renamed") & (n % 6 == 3), folder)
    end = end.when(act("deleted") & (n % 2 == 0), sub).when(act("accessed") & (n % 5 == 0), "").otherwise(leaf)
    before = F.when(act("renamed"), F.when(n % 3 == 0, text).otherwise(F.lit("\\old.txt"))).when(act("permission_changed"), sub)
    e = e.withColumns({
        "path": F.concat(root, end), "previous_path": F.concat(root, before),
        "action": F.when(act("permission_changed"), "moved").when(act("accessed"), "changed").otherwise(F.col("action")),
    })
    return timeline.suppress_echoes(e, 240.0).select("id", "action")


@query("timeline")
def timeline_all(spark, d):
    return timeline.build_timeline(audit_events(spark, d), 900, 3600).select("id", "user", "action", "path", "previous_path", "display_target")


@query("timeline_consolidate")
def timeline_consolidate(spark, d):
    return timeline.timeline_consolidate(timeline.timeline_dedup(audit_events(spark, d)), 900).select("id", "action", "path", "previous_path", "display_target")


@query(
    "provisional_creates",
    audit("""SELECT id, CASE WHEN action = 'renamed' AND event_id % 3 = 0 THEN 'created' ELSE action END AS action, CASE WHEN action = 'renamed' AND event_id % 3 = 0 THEN NULL ELSE previous_path END AS previous_path FROM audit"""),
)
def provisional_creates(spark, d):
    e = audit_events(spark, d)
    fresh = (F.col("action") == "renamed") & (F.col("id").cast("long") % 3 == 0)
    e = e.withColumn("previous_path", F.when(fresh, F.concat(F.lit("\\\\"), "server", F.lit("\\x\\New Text Document.txt"))).otherwise(F.col("previous_path")))
    return timeline.provisional_creates(e).select("id", "action", "previous_path")


@query("read_table", audit("SELECT server, action, count(*) AS n, min(us) AS first_us FROM audit GROUP BY ALL"))
def read_table(spark, d):
    path, _ = _scratch(spark, "stored")
    name = next(k for k in TABLES if "event" in k)
    columns = [f.strip().split(" ")[0] for f in TABLES[name].split(",")]
    e = audit_events(spark, d)
    e.select(*(F.col(c) if c in e.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.parquet(f"{path}/{name}")
    return readers.read_table(spark, name, path).groupBy("server", "action").agg(F.count("*").alias("n"), F.min(F.unix_micros("timestamp_utc")).alias("first_us"))


_CSV = "CASE WHEN contains({0}, ',') OR contains({0}, '\"') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(
    "export_events_csv",
    audit("""SELECT id || ',' || strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00,' || server || ',' || share || ',' || path || ',' || coalesce(previous_path, '') || ',' || object_type || ',' || action || ',' || "user" || ',,' || source_host || ',,' || process_name
    || ',' || file_size_bytes || ',' || coalesce(extension, '') || ',success,info,' || source AS value FROM audit"""),
)
def export_events_csv(spark, d):
    return writers.export_events_csv(audit_events(spark, d))


@query(
    "export_alerts_csv",
    derived("""SELECT id || ',' || rule || ',' || severity || ',' || status || ',Alert ' || rule || ',"Path ""' || path || '"", by ' || "user" || '",' || server || ',' || "user" || ',' || event_count || ',' || t || ',' || t || ',' || t || ',,'
    || CASE WHEN k % 5 <> 0 THEN '"' || path || ' | x,y"' ELSE '' END || ',' || rule || ':' || lower(server) || ':' || lower("user") AS value FROM (SELECT *, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS t FROM alerts)"""),
)
def export_alerts_csv(spark, d):
    return writers.export_alerts_csv(alert_rows(spark, d))


@query("export_anomalies_csv", audit(ANOMALIES + " SELECT dimension || ',' || name || ',' || current_count || ',' || baseline_average || ',' || delta_percent AS value FROM anomalies"))
def export_anomalies_csv(spark, d):
    return writers.export_anomalies_csv(reports.baseline_anomalies(audit_events(spark, d), *RANGE, windows=7, take=8))


def _scratch(spark, name: str) -> tuple[str, str]:
    base = f"{hydrate.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/checkpoint"


def _played(spark, run, *dfs):
    """What ``run`` gives of a stream after the last frame. Each frame is a batch, written by all its tasks and read by
    as many; the stream ends after it and goes on from its checkpoint."""
    path, _ = _scratch(spark, "source")
    for df in dfs:
        df.write.mode("append").parquet(path)
        out = run(spark.readStream.schema(dfs[0].schema).parquet(path))
    return out


def _halves(df, at: str = "2024-01-16 00:00:00"):
    early = F.col("timestamp_utc") < F.lit(at).cast("timestamp")
    return df.filter(early), df.filter(~early)


@query(
    "stream_activity",
    audit("""SELECT us // 86400000000 * 86400000000 AS start_us, lower(server) AS server, lower("user") AS "user", action, count(*) AS event_count FROM audit GROUP BY ALL"""),
)
def stream_activity(spark, d):
    to = _scratch(spark, "activity")
    # the last window is still open when the input ends: complete mode gives it too
    run = lambda live: jobs.run_complete(jobs.stream_activity(live, "1 day", "1 day", "0 seconds"), *to)
    return _played(spark, run, *_halves(audit_events(spark, d))).select(us("window_start", "start_us"), "server", "user", "action", "event_count")


@query("stream_dedup", feed("SELECT CASE cursor_type WHEN 'usn' THEN 'usn:d::' || usn ELSE 'security:' || record_id END AS cursor_key FROM feed"))
def stream_dedup(spark, d):
    c, to = collected_events(spark, d), _scratch(spark, "dedup")
    run = lambda live: jobs.run_available(jobs.stream_dedup(live, "60 days"), *to)
    return _played(spark, run, c.unionByName(c.filter("usn % 3 = 0 or record_id % 4 = 0"))).select("cursor_key")


@query(
    "stream_late_rows",
    feed("""SELECT CASE cursor_type WHEN 'usn' THEN 'usn:d::' || usn ELSE 'security:' || record_id END AS cursor_key FROM feed
    WHERE us < epoch_us(TIMESTAMP '2024-01-16') OR us > (SELECT max(us) FROM feed WHERE us < epoch_us(TIMESTAMP '2024-01-16'))"""),
)
def stream_late_rows(spark, d):
    """The third batch holds copies of early rows under new numbers: they come behind the watermark and go."""
    early, later = _halves(collected_events(spark, d))
    late = early.filter("timestamp_utc < '2024-01-15'").withColumns({"record_id": F.col("record_id") + 10**12, "usn": F.col("usn") + 10**12})
    to = _scratch(spark, "late")
    return _played(spark, lambda live: jobs.run_available(jobs.stream_dedup(live, "0 seconds"), *to), early, later, late).select("cursor_key")


@query("stream_events", audit("SELECT action, count(*) AS n FROM audit WHERE event_id % 11 <> 0 GROUP BY action"))
def stream_events(spark, d):
    e = audit_events(spark, d)
    raw = e.withColumn("server", F.when(F.col("id").cast("long") % 11 == 0, " ").otherwise(F.col("server"))).withColumn("action", F.upper("action"))
    path, checkpoint = _scratch(spark, "in")
    raw.write.parquet(path)
    out, checkpoint2 = _scratch(spark, "events")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    jobs.write_events(jobs.stream_events(spark, path, "parquet", schema), out, checkpoint2).awaitTermination()
    return spark.read.parquet(out).groupBy("action").agg(F.count("*").alias("n"))


@query("stream_heartbeats", derived(f"SELECT agent_id, us, last_record_id FROM ({_LATEST})"))
def stream_heartbeats(spark, d):
    path, checkpoint = _scratch(spark, "beats")
    early, later = _halves(heartbeats(spark, d).withColumnRenamed("last_heartbeat_utc", "timestamp_utc"))
    back = lambda df: df.withColumnRenamed("timestamp_utc", "last_heartbeat_utc")

    def run(live):
        q = jobs.stream_heartbeats(live, path, checkpoint)
        q.awaitTermination()
        return spark.read.schema(live.schema).parquet(jobs.newest_version(path, q))

    # the second batch must not push newer ones out
    return _played(spark, run, back(later), back(early)).select("agent_id", us("last_heartbeat_utc", "us"), "last_record_id")


@query("stream_alerts", audit(_DETECT))
def stream_alerts(spark, d):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        e = audit_events(spark, d)
        # one late row moves the watermark past the others; it belongs to no real key
        end = e.limit(1).withColumns({"timestamp_utc": F.lit("2030-01-01 00:00:00").cast("timestamp"), "server": F.lit("end"), "user": F.lit("end"), "action": F.lit("accessed"), "id": F.lit("end")})
        path, checkpoint = _scratch(spark, "alerts")
        src, _ = _scratch(spark, "source")
        e.unionByName(end).write.parquet(src)
        live = jobs.stream_alerts(spark.readStream.schema(e.schema).parquet(src), test_rules(spark), WINDOW_MIN, DEDUP_MIN, "0 seconds")
        return jobs.run_available(live, path, checkpoint).filter("server <> 'end'")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query("read_collected", feed("""SELECT cursor_type, coalesce(record_id, usn) AS number, path, "user", us FROM feed"""))
def read_collected(spark, d):
    path, _ = _scratch(spark, "feed")
    collected_events(spark, d).withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.json(path)
    return readers.read_collected(spark, path).select("cursor_type", F.coalesce("record_id", "usn").alias("number"), "path", "user", us("timestamp_utc", "us"))


@query(
    "read_collected_rejects",
    feed("""SELECT CASE coalesce(record_id, usn) % 5 WHEN 0 THEN 'unreadable' ELSE 'no cursor type' END AS reason, count(*) AS n, count(DISTINCT coalesce(record_id, usn)) AS records
    FROM feed WHERE coalesce(record_id, usn) % 5 < 2 GROUP BY 1"""),
)
def read_collected_rejects(spark, d):
    """Each fifth line is cut short, each next one has no cursor type, and blank lines lie between."""
    path, _ = _scratch(spark, "rejects")
    c, n = collected_events(spark, d), F.coalesce("record_id", "usn")
    kind = F.when(n % 5 == 1, None).otherwise(F.col("cursor_type"))
    line = F.to_json(F.struct(kind.alias("cursor_type"), "record_id", "usn", "path", "user"))
    c.select(F.when(n % 5 == 0, F.regexp_replace(line, "}$", "\n")).otherwise(line).alias("value")).write.text(path)
    _, rejects = readers.split_collected(spark, path)
    number = F.regexp_extract("record", r'"(?:record_id|usn)":(\d+)', 1)
    return rejects.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct(number).alias("records"))


@query(
    "read_usn_csv",
    audit("""SELECT event_id AS usn, 'D:' AS volume, CAST(us // 1000000 * 1000000 AS BIGINT) AS us, CASE k % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' ELSE 'modified' END AS action, 'f' || k AS file_id, 'file, ' || k AS file_name FROM audit WHERE event_id > 50"""),
)
def read_usn_csv(spark, d):
    path, _ = _scratch(spark, "journal")
    k = F.regexp_extract("path", r"file(\d+)", 1).cast("int")
    reason = F.when(k % 3 == 0, "0x100,File create").when(k % 3 == 1, "0x200,Exclusão").otherwise("0x2,Data_Extend | Close")
    reason = F.regexp_replace(reason, "File create", "FILE_CREATE")
    line = F.concat(
        F.col("id"), F.lit(',"file, '), k.cast("string"), F.lit('",10,'), reason, F.lit(',"'), F.date_format("timestamp_utc", "MM/dd/yyyy HH:mm:ss"), F.lit('",0x20, f'), k.cast("string"), F.lit(" ,p1")
    )
    head = "Usn Journal ID : 0x1\nFirst USN : 0\n\nUsn,File name,File name length,Reason #,Reason,Time stamp,File attributes,File ID,Parent file ID\n"
    audit_events(spark, d).select(F.concat(F.lit(head), line).alias("value")).repartition(4).write.text(path)
    out = readers.read_usn_csv(spark, path, "FS01", "Dados", "D:", "UTC", 50)
    return out.select("usn", "volume", us("timestamp_utc", "us"), "action", "file_id", "file_name")


@query(
    "parse_security_xml",
    audit("""SELECT event_id AS record_id, path || '\\sub.txt' AS path, 'EMPRESA\\x' AS "user", CASE WHEN k % 2 = 0 THEN 'deleted' ELSE 'created_or_appended' END AS action, '.txt' AS extension FROM audit WHERE event_id % 7 <> 0"""),
)
def parse_security_xml(spark, d):
    k, n = F.regexp_extract("path", r"file(\d+)", 1).cast("int"), F.col("id").cast("long")
    data = lambda name, v: F.concat(F.lit(f'<Data Name="{name}">'), v, F.lit("</Data>"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><EventData>'), data("ObjectName", F.col("path")), data("RelativeTargetName", F.lit("sub.txt")),
        data("ObjectType", F.lit("File")), data("AccessMask", F.when(k % 2 == 0, "0x10000").otherwise("0x2")), data("SubjectDomainName", F.lit("EMPRESA")), data("SubjectUserName", F.lit("x")),
        F.when(n % 7 == 0, "</Broken>").otherwise("</EventData></Event>"),
    )
    records = audit_events(spark, d).select(n.alias("record_id"), F.lit(4663).alias("event_id"), F.col("timestamp_utc").alias("time_created"), xml.alias("xml"))
    return readers.parse_security_xml(records, "FS01", "Dados").select("record_id", "path", "user", "action", "extension")


@query("append_events", audit("SELECT CAST(CAST(timestamp_utc AS DATE) AS VARCHAR) AS event_date, count(*) AS n FROM audit GROUP BY 1"))
def append_events(spark, d):
    path, _ = _scratch(spark, "table")
    e = audit_events(spark, d)
    n = F.col("id").cast("long") % 2
    writers.append_events(e.filter(n == 0), path)
    writers.append_events(e.filter(n == 1), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("n"))


@query(
    "batch_log",
    audit("""SELECT CAST(CAST(timestamp_utc AS DATE) AS VARCHAR) AS event_date, count(*) AS n, count(DISTINCT event_id % 3) AS batches,
    (SELECT count(*) FROM audit WHERE us < epoch_us(TIMESTAMP '2024-01-20 12:00:00')) AS purged FROM audit WHERE us >= epoch_us(TIMESTAMP '2024-01-20 12:00:00') GROUP BY 1"""),
)
def batch_log(spark, d):
    """Three batches, one of them sent twice, then ten days' retention, run twice, and what is left."""
    path, _ = _scratch(spark, "batches")
    e = audit_events(spark, d)
    for k in (0, 1, 1, 2):
        batches.append_batch(e.filter(F.col("id").cast("long") % 3 == k), path, f"b{k}")
    purged = [batches.drop_expired(spark, path, 10, AS_OF) for _ in range(2)]
    left = batches.read_events(spark, path).groupBy(F.col("event_date").cast("string").alias("event_date"))
    return left.agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("batches"), F.lit(sum(purged)).cast("long").alias("purged"))


@query(
    "rule_errors",
    audit("""SELECT id, concat_ws('; ',
        CASE WHEN event_id % 5 = 4 THEN 'unknown rule' END,
        CASE WHEN event_id % 5 < 3 AND event_id % 3 < 2 THEN 'threshold is required' END,
        CASE WHEN event_id % 5 = 2 AND event_id % 2 = 0 THEN 'secondary threshold is required' END,
        CASE WHEN event_id % 4 <> 0 AND event_id % 26 > 23 THEN 'hour is out of range' END,
        CASE WHEN (event_id % 4 = 0) <> (event_id % 6 = 0) THEN 'both hours are required' END,
        CASE WHEN event_id % 3 = 0 THEN 'unknown day' END,
        CASE WHEN event_id % 7 = 0 THEN 'unknown time zone' END) AS errors FROM audit"""),
)
def rule_errors(spark, d):
    """A rule for each event, with faults of every kind, and what is wrong with it."""
    e = audit_events(spark, d)
    n = F.col("id").cast("int")
    names = F.array(*map(F.lit, [*rules.RULE_NAMES, "other"]))
    given = {
        "rule": F.get(names, n % 5),
        "title": F.col("id"),
        "threshold": n % 3 - 1,
        "secondary_threshold": n % 2,
        "active_from_hour": F.when(n % 4 != 0, n % 26),
        "active_to_hour": F.when(n % 6 != 0, n % 24),
        "active_days": F.when(n % 3 == 0, "mon,xyz").when(n % 3 == 1, "seg; sunday"),
        "time_zone_id": F.when(n % 7 == 0, "Mars/Base").when(n % 7 == 1, "UTC"),
    }
    fields = spark.createDataFrame([], RULE).schema
    raw = e.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    return rules.normalize_rules(raw).select(F.col("title").alias("id"), F.array_join("errors", "; ").alias("errors"))


@query("write_csv", audit("SELECT id, path, \"user\", CAST(file_size_bytes AS VARCHAR) AS size FROM audit"))
def write_csv(spark, d):
    path, _ = _scratch(spark, "csv")
    writers.write_lines(writers.export_events_csv(audit_events(spark, d)), writers.EVENT_HEADER, path)
    return spark.read.csv(path, header=True, escape='"').select("id", "path", "user", F.col("file_size_bytes").alias("size"))
