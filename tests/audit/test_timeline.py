"""Timeline consolidation, echoes, user resolution and path rebuild on small literal inputs."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditweft.operators import hydrate, timeline
from auditweft.sources.schemas import EVENT

FIELDS = [f.strip().split(" ")[0] for f in EVENT.split(",")]
START = datetime(2024, 5, 1, 12, 0, 0)
ROOT = "\\\\FS01\\Dados"


def event(i, action, path, at=0.0, **kw):
    base = dict(id=str(i), timestamp_utc=START + timedelta(seconds=at), server="FS01", share="Dados", path=f"{ROOT}\\{path}", object_type="file", action=action, user="ana", result="success", severity="info", source="windows-security-log")
    base.update(kw)
    if base.get("previous_path"):
        base["previous_path"] = f"{ROOT}\\{base['previous_path']}"
    return tuple(base.get(f) for f in FIELDS)


def build(spark, *rows):
    df = spark.createDataFrame(list(rows), EVENT)
    out = sorted((r.id, r.action, r.user, r.display_target) for r in timeline.build_timeline(df).collect())
    again = sorted((r.id, r.action, r.user, r.display_target) for r in timeline.build_timeline(df.repartition(3, "id")).collect())
    assert out == again
    return out


def test_rename_takes_its_echoes(spark):
    out = build(
        spark, event(1, "renamed", "d\\new.txt", 5, previous_path="d\\old.txt", source="usn-journal+security-log"), event(2, "deleted", "d\\old.txt", 4), event(3, "created_or_appended", "d\\new.txt", 5),
        event(4, "modified", "d\\new.txt", 6, source="usn-journal", user="UNKNOWN"), event(5, "deleted", "e\\other.txt", 200),
    )
    assert out == [("1", "renamed", "ana", "new.txt"), ("5", "deleted", "ana", "other.txt")]


def test_noise_and_provisional_names_go(spark):
    out = build(
        spark, event(1, "modified", "d\\~$a.docx"), event(2, "deleted", "d\\x.tmp"), event(3, "created", "d\\New Text Document.txt"), event(4, "renamed", "d\\plan.txt", 8, previous_path="d\\New Text Document.txt"),
        event(5, "accessed", "d\\read.me", 100),
    )
    assert out == [("4", "created", "ana", "plan.txt"), ("5", "accessed", "ana", None)]


def test_unknown_user_takes_the_nearest(spark):
    out = build(spark, event(1, "deleted", "d\\a.txt", 0, user="UNKNOWN", source="usn-journal"), event(2, "modified", "d\\b.txt", 20, user="bo"), event(3, "modified", "d\\c.txt", -40, user="eve"))
    assert ("1", "deleted", "bo", "a.txt") in out


def test_suspicious_move_and_folder_echo(spark):
    rows = [event(1, "moved", "d\\a.txt", 0, previous_path="d\\sub\\a.txt"), event(2, "deleted", "d\\sub\\a.txt", 20), event(3, "changed", "f", 0), event(4, "moved", "f\\b.txt", 10, previous_path="g\\b.txt")]
    df = spark.createDataFrame(rows, EVENT)
    assert sorted(r.id for r in timeline.suppress_echoes(df).collect()) == ["2", "4"]
    near = spark.createDataFrame(rows[:2] + [event(5, "modified", "d\\a.txt", 5, user="bo")], EVENT)
    assert "1" in {r.id for r in timeline.suppress_echoes(near).collect()}


def test_paths_follow_renamed_folders(spark):
    rows = [
        (1, "D:", "S", "created", "10", "5", "docs"), (2, "D:", "S", "created", "20", "10", "a.txt"), (3, "D:", "S", "renamed_old", "10", "5", "docs"), (4, "D:", "S", "renamed_new", "10", "5", "papers"),
        (5, "D:", "S", "modified", "21", "10", "b.txt"), (6, "D:", "S", "deleted", "20", "10", "a.txt"), (7, "D:", "S", "modified", "20", "10", "c.txt"), (8, "E:", "S", "modified", "20", "10", "a.txt"),
        (9, "D:", "S", "modified", "30", None, "X:\\own\\z.txt"), (10, "D:", "S", "modified", "31", None, " "),
    ]
    df = spark.createDataFrame(rows, "usn long, volume string, server string, action string, file_id string, parent_file_id string, file_name string")
    got = {r.usn: (r.path, r.previous_path, r.action) for r in hydrate.hydrate_usn_paths(df, "D:\\base").collect()}
    assert got[2][0] == "D:\\base\\docs\\a.txt" and got[5][0] == "D:\\base\\papers\\b.txt" and got[6][0] == "D:\\base\\docs\\a.txt"
    assert got[4] == ("D:\\base\\papers", "D:\\base\\docs", "renamed")
    assert got[7][:2] == ("D:\\base\\papers\\c.txt", None) and got[8][0] == "D:\\base\\a.txt"
    assert got[9][0] == "X:\\own\\z.txt" and got[10][0] == "D:\\base\\"


def test_unknown_users_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        path = rng.choice(["d", "d\\a.txt", "d\\b.txt", "d\\sub\\c.txt", "e\\a.txt", "e", "d\\sub"])
        previous = {"previous_path": rng.choice(["d\\a.txt", "e\\z\\y.txt"])} if rng.random() < 0.2 else {}
        rows.append(event(i, "renamed", path, rng.randrange(0, 1200, 5), user=rng.choice(["UNKNOWN", "ana", "bo", "eve"]), share=rng.choice(["Dados", "RH"]), **previous))
    df = spark.createDataFrame(rows, EVENT)
    got = {r.id: r.user for r in timeline.resolve_unknown_users(df).collect()}
    at = [dict(zip(FIELDS, r)) for r in rows]
    for r in at:
        r["paths"] = [p.lower() for p in (r["path"], r["previous_path"]) if p]
    near = lambda p, q: p.startswith(q + "\\") or q.startswith(p + "\\") or p.rpartition("\\")[0] == q.rpartition("\\")[0]
    for a in at:
        found = [
            (abs(a["timestamp_utc"] - b["timestamp_utc"]), START - b["timestamp_utc"], b["id"], b["user"]) for b in at
            if b["user"] != "UNKNOWN" and b["share"] == a["share"] and abs(a["timestamp_utc"] - b["timestamp_utc"]) <= timedelta(seconds=60) and any(near(p, q) for p in a["paths"] for q in b["paths"])
        ]
        assert got[a["id"]] == (min(found)[3] if a["user"] == "UNKNOWN" and found else a["user"])


def test_unknown_users_of_a_busy_folder_form_no_pairs(spark):
    """20,000 unknown rows and as many known ones in one minute of one folder: 400 million pairs."""
    n = F.col("id")
    df = spark.range(40_000).select(
        n.cast("string").alias("id"), F.timestamp_seconds(1_700_000_000 + n / 1000).alias("timestamp_utc"), F.lit("S").alias("server"), F.lit("D").alias("share"), F.concat(F.lit("\\\\S\\D\\d\\f"), n % 7).alias("path"),
        F.lit(None).cast("string").alias("previous_path"), F.when(n % 2 == 0, "UNKNOWN").otherwise(F.concat(F.lit("u"), n)).alias("user"),
    )
    began = time.time()
    assert timeline.resolve_unknown_users(df).filter(F.col("user") == F.concat(F.lit("u"), (F.col("id") + 1).cast("long"))).filter("id % 2 = 0").count() == 20_000
    assert time.time() - began < 20
