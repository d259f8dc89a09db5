"""Registered queries over the audit events and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, text
from ..operators import alerts, normalize, reports, rules
from ..sources import writers
from .adapter import AUDIT, COLLECTED, audit_events, collected_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sparse test data: wide windows and low thresholds.
WINDOW_MIN, DEDUP_MIN = 24 * 60, 48 * 60
THRESHOLDS = {"mass-delete": (3, None), "mass-rename": (3, None), "possible-ransomware": (5, 2)}
DAY_US = 86_400_000_000
RANGE = ("2024-01-27 00:00:00", "2024-01-30 00:00:00")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def audit(sql: str) -> str:
    return f"WITH RECURSIVE {AUDIT} {sql}"


def feed(sql: str) -> str:
    return f"WITH RECURSIVE {COLLECTED} {sql}"


def us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


@query("store_stats", audit("SELECT count(*) AS event_count, max(us) AS latest_us FROM audit"))
def store_stats(spark, d):
    return reports.store_stats(audit_events(spark, d)).select("event_count", us("latest_utc", "latest_us"))


@query(
    "search_events",
    audit("""SELECT id, us, server, "user", action, path FROM audit WHERE contains(lower(server), 'fs02') AND contains(lower("user"), 'user1') AND action = 'deleted'
    AND us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-20') ORDER BY us DESC, id LIMIT 50"""),
)
def search_events(spark, d):
    out = reports.search_events(audit_events(spark, d), "fs02", "USER1", "Deleted", None, "2024-01-05 00:00:00", "2024-01-20 00:00:00", take=50)
    return out.select("id", us("timestamp_utc", "us"), "server", "user", "action", "path")


@query("text_search", audit("""SELECT id, path, "user" FROM audit WHERE contains(lower(path), 'dir7') OR contains(lower("user"), 'dir7') OR contains(lower(process_name), 'dir7')"""))
def text_search(spark, d):
    return reports.text_search(audit_events(spark, d), ["path", "user", "process_name"], " DIR7 ").select("id", "path", "user")


def _raw_input(spark, d):
    """Untidy input: padded, mixed case, some blanks, from the events."""
    e = audit_events(spark, d)
    n = F.col("id").cast("long")
    return (
        e.withColumn("action", F.concat(F.lit("\t "), F.upper("action"), F.lit(" ")))
        .withColumn("server", F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "server")))
        .withColumn("user", F.when(n % 13 == 0, None).otherwise(F.col("user")))
        .withColumn("extension", F.when(n % 5 == 0, F.upper(F.replace("extension", F.lit("."), F.lit("")))).when(n % 5 == 1, None).otherwise(F.col("extension")))
        .withColumn("result", F.when(n % 2 == 0, " ").otherwise("denied"))
    )


@query(
    "normalize_events",
    audit("""SELECT id, CASE WHEN event_id % 11 = 0 THEN '' ELSE server END AS server, action, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'denied' END AS result, extension, previous_path, source FROM audit"""),
)
def normalize_events(spark, d):
    return normalize.normalize_events(_raw_input(spark, d), "2024-02-01 00:00:00").select("id", "server", "action", "result", "extension", "previous_path", "source")


@query(
    "split_rejects",
    audit("""SELECT coalesce(CASE WHEN event_id % 11 = 0 THEN 'server is required' WHEN event_id % 13 = 0 THEN 'user is required' END, 'accepted') AS outcome, count(*) AS n FROM audit GROUP BY 1"""),
)
def split_rejects(spark, d):
    ok, bad = normalize.split_rejects(_raw_input(spark, d))
    return ok.select(F.lit("accepted").alias("outcome")).union(bad.select("reject_reason")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("derive_extension", audit("""SELECT id, extension FROM audit"""))
def derive_extension(spark, d):
    return audit_events(spark, d).select("id", text.derive_extension(F.lit(" "), F.upper("path")).alias("extension"))


@query(
    "path_parts",
    audit("""SELECT id, lower(path) AS norm, regexp_extract(path, '([^\\\\]*)$', 1) AS leaf, regexp_replace(path, '\\\\[^\\\\]*$', '') AS parent, CASE WHEN event_id % 2 = 0 THEN 'D:' END AS volume FROM audit"""),
)
def path_parts(spark, d):
    p = F.concat(F.lit(" "), F.translate("path", "\\", "/"), F.lit("/ "))
    volume = F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("d:\\"), "path")).otherwise(F.col("path"))
    return audit_events(spark, d).select("id", text.path_key(p).alias("norm"), text.leaf_name(p).alias("leaf"), text.parent_path(p).alias("parent"), text.windows_volume(volume).alias("volume"))


@query(
    "path_score",
    audit("""SELECT id, CASE WHEN previous_path IS NULL THEN 0 WHEN lower(path) = lower(previous_path) THEN 100
    WHEN regexp_extract(lower(path), '([^\\\\]*)$', 1) = regexp_extract(lower(previous_path), '([^\\\\]*)$', 1) THEN 60
    WHEN contains(lower(path), lower(previous_path)) OR contains(lower(previous_path), lower(path)) THEN 30 ELSE 0 END AS score,
    CASE WHEN event_id % 3 = 0 THEN 100 WHEN event_id % 3 = 1 THEN 30 ELSE 60 END AS own FROM audit"""),
)
def path_score(spark, d):
    n = F.col("id").cast("long") % 3
    other = F.when(n == 0, F.upper("path")).when(n == 1, text.parent_path(F.col("path"))).otherwise(F.concat(F.lit("E:\\"), text.leaf_name(F.col("path"))))
    return audit_events(spark, d).select("id", text.path_score(F.col("path"), F.col("previous_path")).alias("score"), text.path_score(F.col("path"), other).alias("own"))


_NAMES = [
    "New Text Document.txt", "new text document (2).txt", "Novo(a) Planilha do Microsoft Excel.xlsx", "New Microsoft Word Document.docx", "nova pasta",
    "Novo(a) Apresentação do Microsoft PowerPoint.pptx", "New Bitmap Image.bmp", "report.docx", "New folder", "~$x.docx", "thumbs.db", "a.tmp", "notes", "$RABC123.txt",
]


def _named(spark, d):
    names = F.array(*map(F.lit, _NAMES))
    return audit_events(spark, d).select("id", F.concat(text.parent_path(F.col("path")), F.lit("\\"), F.get(names, (F.col("id").cast("long") % len(_NAMES)).cast("int"))).alias("path"), F.col("path").alias("own"))


def _case(values: list) -> str:
    return f"CASE event_id % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN {v!r}" if isinstance(v, str) else f"WHEN {i} THEN {str(v).lower()}" for i, v in enumerate(values) if v is not None) + " END"


@query(
    "provisional_kind",
    audit(f"""SELECT id, {_case(['text', 'text', 'excel', 'word', None, 'powerpoint', 'bitmap', None, None, None, None, None, None, None])} AS kind,
    event_id % 14 IN (0, 1, 2, 3, 5, 6) AS provisional, event_id % 14 IN (4, 8) AS folder FROM audit"""),
)
def provisional_kind(spark, d):
    p = F.col("path")
    return _named(spark, d).select("id", text.provisional_kind(p).alias("kind"), text.is_provisional(p).alias("provisional"), text.is_provisional_folder(p).alias("folder"))


@query(
    "transition",
    audit("""SELECT id, CASE WHEN event_id % 14 IN (0, 1, 2, 3, 5, 6) THEN 'created' WHEN event_id % 2 = 0 THEN 'moved' ELSE 'renamed' END AS action,
    CASE WHEN event_id % 3 = 0 THEN 'directory' ELSE 'file' END AS kind FROM audit"""),
)
def transition(spark, d):
    n = F.col("id").cast("long")
    after = F.when(n % 2 == 0, F.concat(F.lit("E:\\x\\"), text.leaf_name(F.col("own")))).otherwise(F.col("own"))
    kind = text.promote_object_type(F.when(n % 3 == 0, "Directory").otherwise("file"), F.lit("unknown"))
    return _named(spark, d).select("id", text.classify_transition(F.col("path"), after).alias("action"), kind.alias("kind"))


@query("transient_noise", audit("""SELECT id, event_id % 14 IN (9, 10, 11, 13) AS transient, event_id % 14 IN (9, 10, 11, 13) OR extension IS NOT DISTINCT FROM '.tmp' AS noise FROM audit"""))
def transient_noise(spark, d):
    return _named(spark, d).select("id", text.is_transient_artifact(F.col("path")).alias("transient"), text.is_operational_noise(F.col("path"), F.col("own")).alias("noise"))


@query(
    "security_action",
    audit("""SELECT id, CASE WHEN k = 1 THEN 'deleted' WHEN k = 2 THEN 'permission_changed' WHEN (k * 4099) & 262144 <> 0 THEN 'permission_changed' WHEN (k * 4099) & 524288 <> 0 THEN 'owner_changed'
    WHEN (k * 4099) & 65600 <> 0 THEN 'deleted' WHEN (k * 4099) & 6 <> 0 OR k % 9 = 4 THEN CASE WHEN k % 3 = 0 THEN 'created' ELSE 'created_or_appended' END
    WHEN (k * 4099) & 272 <> 0 THEN 'modified' ELSE 'accessed' END AS action FROM audit"""),
)
def security_action(spark, d):
    k = F.regexp_extract("path", r"file(\d+)", 1).cast("int")
    mask = F.when(k % 2 == 0, F.concat(F.lit("0x"), F.hex(k * 4099))).otherwise((k * 4099).cast("string"))
    event = F.when(k == 1, 4660).when(k == 2, 4670).otherwise(4663)
    codes = F.when(k % 9 == 4, "%%4416\n\t%%4417").otherwise("%%9999")
    return audit_events(spark, d).select("id", decode.decode_security_action(event, mask, codes, F.when(k % 3 == 0, "Directory").otherwise("File")).alias("action"))


@query(
    "usn_reason",
    audit("""SELECT id, CASE k % 8 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed_old' WHEN 3 THEN 'renamed_new' WHEN 4 THEN 'permission_changed' WHEN 5 THEN 'modified'
    WHEN 6 THEN 'created' ELSE 'changed' END AS action FROM audit"""),
)
def usn_reason(spark, d):
    k = F.regexp_extract("path", r"file(\d+)", 1).cast("int")
    reasons = ["file_create | close", "Exclusão", "RENAME_OLD_NAME", "Renomear: novo nome", "SECURITY_CHANGE", "Data_Extend", "FILE_DELETE | FILE_CREATE", " "]
    return audit_events(spark, d).select("id", decode.decode_usn_reason(F.get(F.array(*map(F.lit, reasons)), k % 8)).alias("action"))


@query("severity_rank", audit("SELECT id, CASE k % 7 WHEN 6 THEN 0 ELSE k % 7 END AS rank FROM audit"))
def severity_rank(spark, d):
    k = F.regexp_extract("path", r"file(\d+)", 1).cast("int")
    names = F.array(*map(F.lit, ["INFO", "low", "Medium", "warning", "high ", "critical", "none"]))
    return audit_events(spark, d).select("id", text.severity_rank(F.get(names, k % 7)).alias("rank"))


_SUMMARY = """, f AS (SELECT * FROM audit WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-03') AND epoch_us(TIMESTAMP '2024-01-25') AND contains(lower(server), 'fs0')),
g AS (SELECT 'action' AS dimension, lower(action) AS key, action AS name FROM f UNION ALL SELECT 'share', lower(share), share FROM f UNION ALL SELECT 'user', lower("user"), "user" FROM f UNION ALL SELECT 'total', '', 'all' FROM f),
c AS (SELECT dimension, key, min(name) AS name, count(*) AS event_count FROM g GROUP BY 1, 2)
SELECT dimension, name, event_count FROM c QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY event_count DESC, key) <= 10"""


@query("activity_summary", audit(_SUMMARY))
def activity_summary(spark, d):
    return reports.activity_summary(audit_events(spark, d), "2024-01-03 00:00:00", "2024-01-25 00:00:00", server="FS0")


ANOMALIES = """, w AS (SELECT k AS w, epoch_us(TIMESTAMP '2024-01-27') - k * 3 * 86400000000 AS a, epoch_us(TIMESTAMP '2024-01-30') - k * 3 * 86400000000 AS b FROM range(0, 8) t(k)),
    g AS (SELECT us, 'action' AS dimension, action AS name FROM audit UNION ALL SELECT us, 'share', share FROM audit UNION ALL SELECT us, 'user', "user" FROM audit),
    c AS (SELECT dimension, name, count(*) FILTER (w = 0) AS current_count, count(*) FILTER (w > 0) / 7.0 AS average FROM g JOIN w ON us BETWEEN a AND b GROUP BY 1, 2),
    r AS (SELECT dimension, name, current_count, round_even(CAST(average AS DOUBLE), 2) AS baseline_average,
      round_even(CASE WHEN average <= 0 THEN 100.0 ELSE CAST(current_count - average AS DOUBLE) / CAST(average AS DOUBLE) * 100 END, 2) AS delta_percent FROM c WHERE current_count > 0),
    anomalies AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY delta_percent DESC, current_count DESC, lower(name)) <= 8)"""


@query("baseline_anomalies", audit(ANOMALIES + " SELECT * FROM anomalies"))
def baseline_anomalies(spark, d):
    return reports.baseline_anomalies(audit_events(spark, d), *RANGE, windows=7, take=8)


@query(
    "investigation_summary",
    audit("""SELECT (SELECT count(*) FROM audit) AS event_count, (SELECT count(DISTINCT lower("user")) FROM audit) AS user_count,
    (SELECT action FROM audit GROUP BY action ORDER BY count(*) DESC, action LIMIT 1) AS dominant_action"""),
)
def investigation_summary(spark, d):
    return reports.investigation_summary(audit_events(spark, d))


def scoped_rules(spark):
    from ..sources.schemas import RULE

    rows = [
        ("mass-delete", None, None, True, "Critical", 3, None, None, "fs01", None, None, 22, 6, None, None, None, None, "America/Sao_Paulo", None),
        ("mass-rename", None, None, True, "high", 3, None, None, None, "RH", None, None, None, "seg, ter,Wed", "EMPRESA\\user7, x", None, None, None, None),
        ("possible-ransomware", None, None, True, "high", 5, 2, "critical", None, None, "//FS03/Financeiro/dir1", None, None, None, None, None, "robocopy.exe", None, None),
        ("permission-change", None, None, True, "high", None, None, None, None, None, None, 5, 5, None, None, None, None, None, None),
    ]
    return rules.normalize_rules(spark.createDataFrame(rows, RULE))


@query(
    "rule_applies",
    audit("""SELECT id, 'mass-delete' AS rule FROM audit WHERE server = 'FS01' AND (hour(timestamp_utc - INTERVAL 3 HOUR) >= 22 OR hour(timestamp_utc - INTERVAL 3 HOUR) < 6)
    UNION ALL SELECT id, 'mass-rename' FROM audit WHERE share = 'RH' AND dayofweek(timestamp_utc) IN (1, 2, 3) AND "user" <> 'EMPRESA\\user7'
    UNION ALL SELECT id, 'possible-ransomware' FROM audit WHERE starts_with(lower(path), '\\\\fs03\\financeiro\\dir1') AND process_name <> 'robocopy.exe'"""),
)
def rule_applies(spark, d):
    return rules.rule_applies(audit_events(spark, d), scoped_rules(spark)).select("id", F.col("r_rule").alias("rule"))


def test_rules(spark):
    return rules.normalize_rules(rules.default_rules(spark, THRESHOLDS))


_HITS = """, rl AS (SELECT * FROM (VALUES ('mass-delete', 3, NULL), ('mass-rename', 3, NULL), ('possible-ransomware', 5, 2), ('permission-change', 1, NULL)) v(rule, t, t2)),
pts AS (SELECT rule, t, t2, id, us, server, "user", action, extension, coalesce(extension = '.locked', false) AS mark,
  CASE rule WHEN 'mass-delete' THEN action = 'deleted' WHEN 'mass-rename' THEN action = 'renamed' WHEN 'permission-change' THEN action = 'permission_changed'
  ELSE action IN ('modified', 'renamed', 'deleted', 'created', 'created_or_appended') END AS hit FROM audit, rl)"""
_SEV = "CASE rule WHEN 'mass-delete' THEN 'critical' WHEN 'possible-ransomware' THEN CASE WHEN n2 >= 2 THEN 'critical' ELSE 'high' END ELSE 'high' END"


@query(
    "evaluate_rules",
    audit(_HITS + f""", g AS (SELECT rule, t, t2, server, "user", CASE WHEN rule = 'permission-change' THEN id ELSE '' END AS one, count(*) AS event_count, count(*) FILTER (mark) AS n2, min(us) AS first_us, max(us) AS last_us
    FROM pts WHERE hit GROUP BY ALL)
    SELECT rule, {_SEV} AS severity, server, "user", event_count, first_us, last_us, rule || ':' || lower(server) || ':' || lower("user") AS dedup_key FROM g WHERE event_count >= t OR n2 >= t2"""),
)
def evaluate_rules(spark, d):
    out = rules.evaluate_rules(audit_events(spark, d), test_rules(spark))
    return out.select("rule", "severity", "server", "user", "event_count", us("first_event_utc", "first_us"), us("last_event_utc", "last_us"), "dedup_key")


@query(
    "sample_paths",
    audit(_HITS + """, g AS (SELECT rule, t, t2, server, "user", count(*) AS n, count(*) FILTER (mark) AS n2 FROM pts WHERE hit AND rule <> 'permission-change' GROUP BY ALL HAVING n >= t OR n2 >= t2),
    p AS (SELECT rule, server, "user", lower(a.path) AS k, min_by(a.path, (a.us, a.id)) AS path, min((a.us, a.id)) AS f FROM pts JOIN audit a USING (id) WHERE hit GROUP BY rule, pts.server, pts."user", lower(a.path), server, "user"),
    q AS (SELECT *, row_number() OVER (PARTITION BY rule, server, "user" ORDER BY f) AS r FROM p)
    SELECT rule, g.server, g."user", string_agg(path, '|' ORDER BY r) AS samples FROM g JOIN q USING (rule, server, "user") WHERE r <= 10 GROUP BY ALL""".replace("SELECT rule, server, \"user\", lower(a.path) AS k", "SELECT rule, a.server AS server, a.\"user\" AS \"user\", lower(a.path) AS k").replace("GROUP BY rule, pts.server, pts.\"user\", lower(a.path), server, \"user\"", "GROUP BY rule, a.server, a.\"user\", lower(a.path)")),
)
def sample_paths(spark, d):
    e, r = audit_events(spark, d), test_rules(spark)
    found = rules.evaluate_rules(e, r.filter("rule <> 'permission-change'"))
    return rules.sample_paths(found, e, r).select("rule", "server", "user", F.array_join("sample_paths", "|").alias("samples"))


_WINDOWED = _HITS + """, fr AS (SELECT *, count(*) FILTER (hit) OVER w AS n, count(*) FILTER (hit AND mark) OVER w AS n2, min(us) FILTER (hit) OVER w AS first_us, max(us) FILTER (hit) OVER w AS last_us
  FROM pts WINDOW w AS (PARTITION BY rule, server, "user" ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
fire AS (SELECT * FROM fr WHERE n > 0 AND (n >= t OR n2 >= t2))"""


@query(
    "simulate_rule",
    audit(_WINDOWED + f"""SELECT DISTINCT rule, {_SEV} AS severity, lower(server) AS server, lower("user") AS "user", CASE WHEN rule = 'permission-change' THEN 1 ELSE n END AS event_count,
    CASE WHEN rule = 'permission-change' THEN us ELSE first_us END AS first_us, CASE WHEN rule = 'permission-change' THEN us ELSE last_us END AS last_us FROM fire WHERE rule <> 'permission-change' OR hit"""),
)
def simulate_rule(spark, d):
    return alerts.simulate_rule(audit_events(spark, d), test_rules(spark), WINDOW_MIN)


@query(
    "simulation_counts",
    audit(_WINDOWED + """, s AS (SELECT DISTINCT rule, server, "user", CASE WHEN rule = 'permission-change' THEN 1 ELSE n END AS c, CASE WHEN rule = 'permission-change' THEN us ELSE first_us END AS a,
    CASE WHEN rule = 'permission-change' THEN us ELSE last_us END AS b FROM fire WHERE rule <> 'permission-change' OR hit)
    SELECT rule, count(*) AS evaluated, count(*) FILTER (hit) AS matching, (SELECT count(*) FROM s WHERE s.rule = pts.rule) AS alerts FROM pts GROUP BY rule"""),
)
def simulation_counts(spark, d):
    return alerts.simulation_counts(audit_events(spark, d), test_rules(spark), WINDOW_MIN)


_DETECT = _WINDOWED + f""", o AS (SELECT *, row_number() OVER (PARTITION BY rule, server, "user" ORDER BY us) AS i FROM fire),
kept AS (SELECT rule, server, "user", i, us FROM o WHERE i = 1
  UNION ALL SELECT n.rule, n.server, n."user", n.i, n.us FROM kept k, LATERAL (SELECT * FROM o WHERE o.rule = k.rule AND o.server = k.server AND o."user" = k."user" AND o.us > k.us + {2 * DAY_US} ORDER BY o.us LIMIT 1) n)
SELECT rule, {_SEV} AS severity, lower(o.server) AS server, lower(o."user") AS "user", CASE WHEN rule = 'permission-change' THEN 1 ELSE n END AS event_count, first_us,
  CASE WHEN rule = 'permission-change' THEN first_us ELSE last_us END AS last_us, us AS fired_us FROM o JOIN kept USING (rule, server, "user", i, us)"""


@query("detect_alerts", audit(_DETECT))
def detect_alerts(spark, d):
    return alerts.detect_alerts(audit_events(spark, d), test_rules(spark), WINDOW_MIN, DEDUP_MIN)
