"""Readers for collected feeds, journal exports, event XML and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, text
from ..operators.hydrate import cut
from .schemas import COLLECTED, TABLES

# Header patterns of journal exports, English and Portuguese.
USN_HEADERS = {
    "file_name": r"(?i)(file ?name|nome do arquivo)",
    "time": r"(?i)(time ?stamp|carimbo de data|data/hora)",
    "file_id": r"(?i)^\s*\"?(file ?id|id do arquivo|file reference)",
    "parent_id": r"(?i)(parent|pai)",
    "reason": r"(?i)(reason|motivo|razão)",
}


#: Files whose headers are sent to all executors at once, and salts per file beyond that.
BROADCAST_FILES, FILE_SALTS = 100_000, 64


def read_collected(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Collected events as NDJSON (offline queue; blank lines are skipped) or as JSON arrays, without rejects."""
    return split_collected(spark, path, multi_line)[0]


def split_collected(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of collected files; rejects are (file, reason, record).

    ``unreadable``: no JSON, or a field of another type; the record is the line, with ``multi_line`` the whole
    file that holds it. ``no cursor type``: readable, but neither feed's; the record is its JSON. Blank lines
    are neither. An array in one line is a row for each of its objects.
    """
    bad = "_corrupt_record"
    raw = spark.read.schema(f"{COLLECTED}, {bad} string").option("columnNameOfCorruptRecord", bad).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    names = [c for c in raw.columns if c != bad]
    reason = F.when(F.col(bad).isNotNull(), "unreadable").when(F.col("cursor_type").isNull(), "no cursor type")
    judged = raw.select(*names, bad, F.col("_metadata.file_path").alias("file"), reason.alias("reason"))
    rejects = judged.filter("reason IS NOT NULL").select("file", "reason", F.coalesce(bad, F.to_json(F.struct(*names))).alias("record"))
    return judged.filter("reason IS NULL").select(*names), rejects


def _fields(line: Column) -> Column:
    """A line's fields, parted by the commas outside quotes; the quotes stay. One pass, whatever its length."""
    outside = F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", "\x01")).otherwise(p))
    return F.split(F.array_join(outside, '"'), "\x01", -1)


def _field(cols: Column, header: Column, pattern: str, last: bool = False) -> Column:
    names = F.transform(F.split(header, ","), lambda h: h.rlike(pattern))
    at = F.when(F.array_position(names, True) == 0, None).otherwise(
        (F.size(names) + 1 - F.array_position(F.reverse(names), True)) if last else F.array_position(names, True)
    )
    return F.regexp_replace(F.get(cols, (at - 1).cast("int")), r'^\s*"?|"?\s*$', "")


def read_usn_csv(spark: SparkSession, path: str, server: str, share: str, volume: str, zone: str = "UTC", start_usn: int = 0, fallback: str = "1970-01-01 00:00:00") -> DataFrame:
    """Journal exports: preamble lines, then a header that starts with Usn, then rows.

    Every file's first header, in file order, names its columns: the first match counts, but for the
    reason the last. Rows whose number can't be read (later headers as well), or isn't above ``start_usn``, go.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    heads = cut(lines.filter(F.col("line").rlike(r"(?i)^\s*\"?usn\"?,")).groupBy("file").agg(F.min_by("line", "at").alias("header")))
    if heads.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        rows = lines.join(F.broadcast(heads), "file")
    else:
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(FILE_SALTS)).cast("int"))
        rows = salted.join(heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FILE_SALTS - 1)))), ["file", "salt"])
    cols = _fields(F.col("line"))
    head = F.col("header")
    usn = F.regexp_replace(F.get(cols, F.lit(0)), r'["\s]', "")
    reason = _field(cols, head, USN_HEADERS["reason"], last=True)
    return (
        rows.select(
            F.when(usn.rlike("^[0-9]{1,18}$"), usn.cast("long")).otherwise(0).alias("usn"),
            F.lit(volume).alias("volume"),
            decode.parse_usn_timestamp(_field(cols, head, USN_HEADERS["time"]), zone, F.lit(fallback).cast("timestamp")).alias("timestamp_utc"),
            F.lit(server).alias("server"),
            F.lit(share).alias("share"),
            decode.decode_usn_reason(reason).alias("action"),
            reason.alias("reason"),
            decode.normalize_reference_id(_field(cols, head, USN_HEADERS["file_id"])).alias("file_id"),
            decode.normalize_reference_id(_field(cols, head, USN_HEADERS["parent_id"])).alias("parent_file_id"),
            _field(cols, head, USN_HEADERS["file_name"]).alias("file_name"),
        )
    ).filter(F.col("usn") > start_usn)


# Fields of a security record, and a character that no XML document can hold.
XML_FIELDS = ["ObjectName", "RelativeTargetName", "TargetFilename", "FileName", "FilePath", "Name", "ObjectType", "AccessMask", "AccessList", "SubjectDomainName", "SubjectUserName", "SubjectUserSid", "ProcessName"]
XML_NEVER = "\uffff"


def parse_security_xml(df: DataFrame, server: str, share: str) -> DataFrame:
    """Security records (record_id, event_id, time_created, xml) as collected events; unreadable XML goes.

    A record is parsed once: one expression gives all fields, parted by a character that XML excludes.
    """
    plain = df.filter(F.col("xml").rlike(r"(?s)^\s*<(?:\?xml[^>]*>\s*<)?Event[\s>].*</Event>\s*$")).withColumn("xml", F.regexp_replace("xml", r"\sxmlns=(\"[^\"]*\"|'[^']*')", ""))
    fields = f', "{XML_NEVER}", '.join(f'Event/EventData/Data[@Name="{name}"]' for name in XML_FIELDS)
    plain = plain.withColumn("_data", F.split(F.xpath_string("xml", F.lit(f"concat({fields})")), XML_NEVER, -1))
    d = lambda name: F.get("_data", F.lit(XML_FIELDS.index(name)))
    path = decode.resolve_security_path(d("ObjectName"), *(d(n) for n in ("RelativeTargetName", "TargetFilename", "FileName", "FilePath", "Name")))
    kind = decode.security_object_type(d("ObjectType"))
    return plain.select(
        F.lit("security").alias("cursor_type"),
        "record_id",
        F.col("time_created").alias("timestamp_utc"),
        F.lit(server).alias("server"),
        F.lit(share).alias("share"),
        path.alias("path"),
        kind.alias("object_type"),
        decode.decode_security_action(F.col("event_id"), d("AccessMask"), d("AccessList"), d("ObjectType")).alias("action"),
        decode.security_user(d("SubjectDomainName"), d("SubjectUserName")).alias("user"),
        text.blank_to_null(d("SubjectUserSid")).alias("sid"),
        text.blank_to_null(d("ProcessName")).alias("process_name"),
        text.derive_extension(F.lit(None).cast("string"), path).alias("extension"),
        F.lit("windows-security-log").alias("source"),
    )


# The column by which a stored table is split.
TIMES = {"events": "timestamp_utc", "alerts": "created_utc", "rules": "updated_utc", "heartbeats": "last_heartbeat_utc", "monitored_paths": "updated_utc", "admin_audit": "timestamp_utc"}


def read_table(spark: SparkSession, name: str, source: str, jdbc: dict | None = None, span: tuple[str, str] | None = None, parts: int = 64) -> DataFrame:
    """A stored table with its fixed schema: parquet below ``source``, or a database by JDBC.

    With ``span`` (first and last time) the database is read by ``parts`` queries over equal shares of that
    time, so that no task reads the whole table; rows outside the span fall into the first and last share,
    none is left out. Without it one task reads all. Columns are matched by name whatever their case, cast
    to the schema's types; arrays and maps are read from JSON text.
    """
    if jdbc is None:
        return spark.read.schema(TABLES[name]).parquet(f"{source}/{name}")
    split = {} if span is None else {"partitionColumn": TIMES[name], "lowerBound": span[0], "upperBound": span[1], "numPartitions": str(parts)}
    raw = spark.read.format("jdbc").options(url=source, dbtable=name, **split, **jdbc).load()
    schema = spark.createDataFrame([], TABLES[name]).schema
    nested = lambda f: f.dataType.typeName() in ("array", "map")
    return raw.select(*((F.from_json(F.col(f"`{f.name}`"), f.dataType) if nested(f) else F.col(f"`{f.name}`").cast(f.dataType)).alias(f.name) for f in schema))
