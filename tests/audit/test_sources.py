"""Batches stored once, retention that deletes, rejected lines, journal headers in file order, tables by JDBC."""

import time
from datetime import datetime, timedelta

import pytest
from auditweft.operators import correlate, hydrate
from auditweft.sources import batches, readers
from auditweft.sources.schemas import ADMIN_AUDIT
from pyspark.sql import functions as F
from test_rules import event, frame

DAY = 86_400


def kept(spark, path):
    return sorted(r.id for r in batches.read_events(spark, path).select("id").collect())


def test_a_retried_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert kept(spark, path) == [] and batches.drop_expired(spark, path, 1, "2024-05-02 00:00:00") == 0
    rows = frame(spark, [event(i, i * DAY / 2) for i in range(6)] + [event("none", timestamp_utc=None)])
    assert batches.append_batch(rows, path, "a1")
    assert not batches.append_batch(rows, path, "a1")
    assert batches.append_batch(frame(spark, [event("x", 0)]), path, "a2")
    assert batches.append_batch(rows.limit(0), path, "empty")
    assert kept(spark, path) == ["0", "1", "2", "3", "4", "5", "none", "x"]
    assert sorted((r.batch_id, r.rows) for r in batches.stored_batches(spark, path).collect()) == [("a1", 7), ("a2", 1), ("empty", 0)]
    with pytest.raises(ValueError):
        batches.append_batch(rows, path, "../b")


def test_a_batch_cut_short_is_invisible_and_its_retry_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    batches.append_batch(frame(spark, [event("a", 0)]), path, "one")
    rest = frame(spark, [event("b", 0), event("lost", 9 * DAY)]).select("*", F.to_date("timestamp_utc").alias("event_date"), F.lit("two").alias("batch_id"))
    rest.write.mode("append").partitionBy("event_date", "batch_id").parquet(f"{path}/events")
    assert kept(spark, path) == ["a"]
    assert batches.append_batch(frame(spark, [event("b", 0), event("c", DAY)]), path, "two")
    assert kept(spark, path) == ["a", "b", "c"]


def test_retention_deletes_folders_and_rows_of_the_border_day(spark, tmp_path):
    path = str(tmp_path / "t")
    at = [event(f"{b}{h}", h * 3600) for b in "ab" for h in range(0, 96, 6)]  # from noon on May 1
    batches.append_batch(frame(spark, [r for r in at if r[0][0] == "a"] + [event("none", timestamp_utc=None)]), path, "a")
    batches.append_batch(frame(spark, [r for r in at if r[0][0] == "b"]), path, "b")
    batches.append_batch(frame(spark, [event("c", 39 * 3600)]), path, "c")  # May 3, 03:00: nothing of it stays on that day
    gone = batches.drop_expired(spark, path, 2, "2024-05-05 05:00:00")
    limit = datetime(2024, 5, 3, 5)
    start = datetime(2024, 5, 1, 12)
    want = sorted(r[0] for r in at if start + timedelta(hours=int(r[0][1:])) >= limit)
    assert kept(spark, path) == sorted([*want, "none"]) and gone == len(at) - len(want) + 1
    days = sorted(p.name for p in (tmp_path / "t" / "events").glob("event_date=*"))
    assert days[0] == "event_date=2024-05-03" and not (tmp_path / "t" / "events" / days[0] / "batch_id=c").exists()
    assert batches.drop_expired(spark, path, 2, "2024-05-05 05:00:00") == 0
    assert not batches.append_batch(frame(spark, [event("c", 39 * 3600)]), path, "c")


def test_rejected_lines(spark, tmp_path):
    f = tmp_path / "queue.ndjson"
    f.write_text('{"cursor_type":"usn","usn":5,"path":"a"}\n\n{"cursor_type":"usn","usn":\n{"cursor_type":"usn","usn":"five"}\n{"path":"b"}\n[{"cursor_type":"security","record_id":1},{"cursor_type":"security","record_id":2}]\n')
    good, bad = readers.split_collected(spark, str(f))
    assert sorted((r.cursor_type, r.usn, r.record_id) for r in good.collect()) == [("security", None, 1), ("security", None, 2), ("usn", 5, None)]
    got = bad.collect()
    assert sorted((r.reason, r.record) for r in got) == sorted([("no cursor type", '{"path":"b"}'), ("unreadable", '{"cursor_type":"usn","usn":"five"}'), ("unreadable", '{"cursor_type":"usn","usn":')])
    assert all(r.file.endswith("queue.ndjson") for r in got)
    assert bad.groupBy("reason").count().count() == 2


def test_arrays_over_several_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"cursor_type": "usn",\n  "usn": 1},\n {"cursor_type": "usn", "usn": 2},\n {"usn": 3}\n]\n')
    (tmp_path / "b.json").write_text('[\n {"cursor_type": "usn",\n')
    good, bad = readers.split_collected(spark, str(tmp_path), multi_line=True)
    assert sorted(r.usn for r in good.collect()) == [1, 2]
    assert sorted((r.file[-6:], r.reason) for r in bad.collect()) == [("a.json", "no cursor type"), ("b.json", "unreadable")]


def test_first_header_counts_and_long_lines_are_quick(spark, tmp_path):
    name = "n," * 500_000
    text = 'First USN : 0\nUsn,File name,Reason,File ID\n7,"a, b.txt",0x100,f1\nUsn,File ID,Reason,File name\n8,c.txt,0x200,f2\n9,"' + name + '",0x2,f3\n'
    (tmp_path / "j.csv").write_text(text)
    (tmp_path / "k.csv").write_text("Usn,File ID,Reason,File name\r\n3,f9,0x100,z.txt\r\n")
    start = time.time()
    got = {r.usn: (r.file_name, r.file_id) for r in readers.read_usn_csv(spark, str(tmp_path), "S", "D", "D:").collect()}
    assert time.time() - start < 30
    assert {u: v for u, v in got.items() if u != 9} == {3: ("z.txt", "f9"), 7: ("a, b.txt", "f1"), 8: ("c.txt", "f2")}
    assert got[9] == (name, "f3")


def test_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "BROADCAST_FILES", 0)
    test_first_header_counts_and_long_lines_are_quick(spark, tmp_path)


def test_table_by_jdbc_in_shares_of_time(spark, tmp_path):
    rows = [(str(i), datetime(2024, 5, 1) + timedelta(hours=i), "path.update", "path", str(i), "ana", None, None) for i in range(48)]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    stored = spark.createDataFrame(rows, ADMIN_AUDIT)
    stored.write.format("jdbc").options(url=url, dbtable="admin_audit", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    read = readers.read_table(spark, "admin_audit", url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, ("2024-05-01 06:00:00", "2024-05-02 06:00:00"), 4)
    assert read.schema == stored.schema and read.rdd.getNumPartitions() == 4
    assert sorted(map(str, read.collect())) == sorted(map(str, stored.collect()))


@pytest.mark.parametrize("bits", [(2, 4), (0,), correlate.SEGMENT_BITS])
def test_next_row_over_segments(spark, bits):
    """Rows whose numbers straddle segments, some segments empty, rows without a number, equal numbers."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.randint(0, 90), rng.randint(0, 90), 1 << 62]), rng.randint(0, 50_000), f"r{i}") for i in range(150)]
    df = hydrate.cut(spark.createDataFrame(rows, "k string, usn long, us long, _row string"))
    got = {r._row: r._next and r._next._row for r in correlate._with_next(df, ["k"], ["_row"], bits).collect()}
    want = {}
    for k in "ab":
        own = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])]
        want |= dict(zip(own, [*own[1:], None]))
    assert got == want


def test_security_xml_is_parsed_once(spark):
    data = lambda **kw: "".join(f'<Data Name="{k}">{v}</Data>' for k, v in kw.items())
    event = lambda body: f'<Event xmlns="http://x"><EventData>{body}</EventData></Event>'
    rows = [
        (1, event(data(ObjectName="D:\\Dados\\a &amp; b.txt", ObjectType="File", AccessMask="0x10000", SubjectDomainName="E", SubjectUserName="x", SubjectUserSid="S-1", ProcessName="p.exe"))),
        (2, event(data(ObjectName="", ObjectType="", AccessMask="0x2", SubjectUserName="y", FileName="D:\\Dados\\<![CDATA[c<d.doc]]>") + data(FileName="later"))),
    ]
    df = spark.createDataFrame([(i, 4663, x) for i, x in rows], "record_id long, event_id int, xml string").withColumn("time_created", F.lit("2024-01-01").cast("timestamp"))
    out = readers.parse_security_xml(df, "FS01", "Dados")
    # every further call would parse the whole record again
    assert out._jdf.queryExecution().optimizedPlan().toString().count('Data[@Name="ObjectName"]') == 1
    got = {r.record_id: (r.path, r.action, r.user, r.sid, r.process_name, r.extension) for r in out.collect()}
    assert got[1] == ("D:\\Dados\\a & b.txt", "deleted", "E\\x", "S-1", "p.exe", ".txt")
    assert got[2][0] == "D:\\Dados\\c<d.doc" and got[2][3:] == (None, None, ".doc")
