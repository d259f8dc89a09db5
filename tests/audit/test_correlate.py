"""The correlation scenarios: small literal inputs and their outcomes."""

from datetime import datetime, timedelta

import pytest
from auditweft.operators import correlate
from auditweft.sources.schemas import COLLECTED

START = datetime(2024, 5, 1, 12, 0, 0)
FIELDS = [f.strip().split(" ")[0] for f in COLLECTED.split(",")]


def row(**kw):
    base = dict(
        server="FS01", share="Dados", object_type="file", sid="S-1-5-21-1", source_host="WKS-001", process_name="explorer.exe", result="success", severity="info", user="EMPRESA\\ana",
        cursor_type="security", source="windows-security-log",
    )
    base.update(kw)
    base["timestamp_utc"] = START + timedelta(seconds=base.pop("at", 0))
    return tuple(base.get(f) for f in FIELDS)


def security(n, path, action="modified", **kw):
    return row(record_id=n, path=path, action=action, **kw)


def journal(n, path, action, **kw):
    kw = {"volume": "D:", "user": "UNKNOWN", "process_name": "fsutil.exe", "sid": None, "source_host": None, "source": "usn-journal", "cursor_type": "usn", **kw}
    return row(usn=n, path=path, action=action, **kw)


@pytest.fixture(scope="module")
def run(spark):
    def go(*rows, **kw):
        return correlate.correlate(spark.createDataFrame(list(rows), COLLECTED), 10, **kw).collect()

    return go


def usn(rows):
    return [r for r in rows if r.cursor_type == "usn"]


def records(rows):
    return {r.record_id for r in rows if r.cursor_type == "security"}


def test_enrich_by_path(run):
    (r,) = usn(run(journal(1, "D:\\d\\a.txt", "modified"), security(10, "D:\\d\\a.txt", process_name="WINWORD.EXE", at=2)))
    assert (r.user, r.process_name, r.source) == ("EMPRESA\\ana", "WINWORD.EXE", "usn-journal+security-log")


def test_exact_path_beats_same_leaf(run):
    (r,) = usn(run(journal(1, "D:\\d\\a.txt", "modified"), security(10, "D:\\x\\a.txt", user="other", at=0), security(11, "D:\\d\\a.txt", at=5)))
    assert r.user == "EMPRESA\\ana"


def test_outside_window_stays(run):
    (r,) = usn(run(journal(1, "D:\\d\\a.txt", "modified"), security(10, "D:\\d\\a.txt", at=11)))
    assert r.user == "UNKNOWN" and r.source == "usn-journal"


def test_renames_collapse_and_echoes_go(run):
    out = run(
        journal(1, "D:\\d\\old.txt", "renamed_old", file_reference_id="7"), journal(2, "D:\\d\\new.txt", "renamed_new", file_reference_id="7", at=1),
        security(10, "D:\\d\\old.txt", "deleted"), security(11, "D:\\d\\new.txt", "created_or_appended", at=1),
    )
    (r,) = usn(out)
    assert (r.action, r.path, r.previous_path, r.user) == ("renamed", "D:\\d\\new.txt", "D:\\d\\old.txt", "EMPRESA\\ana")
    assert records(out) == set()


def test_interleaved_and_inferred(run):
    out = usn(run(journal(1, "D:\\d\\a.txt", "renamed_old", file_reference_id="7"), journal(2, "D:\\d\\b.txt", "changed", file_reference_id="8"), journal(3, "D:\\d\\c.txt", "renamed_new", file_reference_id="7")))
    assert sorted(r.action for r in out) == ["changed", "renamed"]
    (r,) = usn(run(journal(1, "D:\\d\\a.txt", "changed", file_reference_id="7"), journal(2, "D:\\d\\b.txt", "changed", file_reference_id="7", at=3)))
    assert (r.action, r.previous_path) == ("renamed", "D:\\d\\a.txt")


@pytest.mark.parametrize("name", ["Nova imagem de bitmap.bmp", "Novo(a) Planilha do Microsoft Excel.xlsx"])
def test_provisional_origin_is_a_creation(run, name):
    (r,) = usn(run(journal(1, f"D:\\d\\{name}", "renamed_old", file_reference_id="7"), journal(2, "D:\\d\\final.bin", "renamed_new", file_reference_id="7")))
    assert (r.action, r.previous_path) == ("created", None)


def test_provisional_change_with_security_create(run):
    path = "D:\\d\\Novo Documento de Texto.txt"
    (r,) = usn(run(journal(1, path, "changed"), security(10, path, "created_or_appended", at=1)))
    assert r.action == "created"


def test_move_and_different_files(run):
    (r,) = usn(run(journal(1, "D:\\d\\a.txt", "renamed_old", file_reference_id="7"), journal(2, "D:\\e\\a.txt", "renamed_new", file_reference_id="7")))
    assert r.action == "moved"
    out = usn(run(journal(1, "D:\\d\\a.txt", "changed", file_reference_id="7"), journal(2, "D:\\d\\b.txt", "changed", file_reference_id="8")))
    assert sorted(r.action for r in out) == ["changed", "changed"] and all(r.previous_path is None for r in out)


def test_order_of_rows_does_not_matter(spark):
    rows = [journal(i, f"D:\\d\\f{i % 5}.txt", ["renamed_old", "renamed_new", "changed"][i % 3], file_reference_id=str(i % 4), at=i % 13) for i in range(60)]
    rows += [security(100 + i, f"D:\\d\\f{i % 6}.txt", ["deleted", "modified"][i % 2], at=i % 17) for i in range(40)]
    df = spark.createDataFrame(rows, COLLECTED)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(correlate.correlate(df)) == key(correlate.correlate(df.repartition(3, "path")))


def plain_pass(rows, window=10):
    """Pairing and inference by a plain pass in journal order over rows (usn, at, action, file, path)."""
    noise, marks = ("changed", "modified", "created", "created_or_appended"), ("renamed_old", "renamed_new")
    rows, used, out = sorted(rows), set(), []
    for i, r in enumerate(rows):
        if i in used:
            continue
        if r[2] in marks:
            kind = marks[1 - marks.index(r[2])]
            picks = [((j > i) != (r[2] == "renamed_old"), abs(rows[j][0] - r[0]), j) for j in range(len(rows)) if rows[j][2] == kind and rows[j][3] == r[3]]
        elif r[2] in noise:
            picks = [(rows[j][1], rows[j][0], j) for j in range(len(rows)) if j != i and j not in used and rows[j][2] in noise and rows[j][3] == r[3] and rows[j][4] != r[4] and abs(rows[j][1] - r[1]) <= window]
        else:
            picks = []
        if not picks:
            out.append((r[0], r[4], None, "renamed" if r[2] in marks else r[2]))
            continue
        j = min(picks)[-1]
        old, new = (r, rows[j]) if r[2] == "renamed_old" else (rows[j], r)
        if r[2] in noise:
            old, new = sorted((r, rows[j]), key=lambda x: (x[1], x[0]))
        for k, e in enumerate(rows):
            if k not in (i, j) and e[2] in noise and (e[3] == new[3] or e[4] in (old[4], new[4])) and abs(e[1] - new[1]) <= window:
                used.add(k)
        used.add(j)
        out.append((new[0], new[4], old[4], "renamed"))
    return sorted(map(str, out))


def test_transitions_equal_a_plain_pass(spark):
    import random

    rng = random.Random(12)
    actions = ["renamed_old", "renamed_new", "changed", "modified", "created", "created_or_appended", "deleted"]
    rows, want = [], []
    for case in range(120):
        own = []
        at = 0
        for n in range(rng.randint(1, 14)):
            at += rng.choice([0, 1, 3, 6, 11, 30])
            file = rng.randint(0, 1)
            own.append((1000 * case + n, at, rng.choice(actions[: rng.choice([2, 5, 7])] if rng.random() < 0.5 else actions), str(file), f"D:\\c{case}\\f{file}{rng.choice('abc')}.txt"))
        want += plain_pass(own)
        rows += [journal(u, p, a, file_reference_id=f, at=t, server=f"FS{case}") for u, t, a, f, p in own]
    usn = correlate.with_row(spark.createDataFrame(rows, COLLECTED))
    out = correlate.apply_transitions(usn, correlate.transitions(usn, 10), 10).collect()
    assert sorted(str((r.usn, r.path, r.previous_path, r.action)) for r in out) == sorted(want)


def test_four_names_one_after_another(run):
    rows = usn(run(*(journal(i, f"D:\\d\\{c}.txt", "modified", file_reference_id="7", at=i) for i, c in enumerate("abcd"))))
    assert [(r.action, r.path, r.previous_path) for r in rows] == [("renamed", "D:\\d\\b.txt", "D:\\d\\a.txt")]


def test_repeated_rows_count_once(run):
    twice = [journal(1, "D:\\d\\a.txt", "renamed_old", file_reference_id="7"), journal(2, "D:\\d\\b.txt", "renamed_new", file_reference_id="7", at=1)] * 2
    assert [(r.action, r.previous_path) for r in usn(run(*twice))] == [("renamed", "D:\\d\\a.txt")]


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Stored rows look small to Spark, as do rows made many by their keys: only counts by hash bucket are broadcast."""
    plans, plain = [], correlate.cut
    monkeypatch.setattr(correlate, "cut", lambda df: plans.append(df) or plain(df))
    rows = [journal(i, f"D:\\d\\f{i % 5}.txt", ["renamed_old", "renamed_new", "changed"][i % 3], file_reference_id=str(i % 4), at=i) for i in range(30)]
    rows += [security(100 + i, f"D:\\d\\f{i % 6}.txt", "modified", at=i) for i in range(30)]
    plans.append(correlate.correlate(spark.createDataFrame(rows, COLLECTED)))
    usn, sec = (plain(correlate.with_row(spark.createDataFrame(rows, COLLECTED)).filter(f"cursor_type = '{c}'")) for c in ("usn", "security"))
    plans += [correlate.correlate_feeds(usn, sec), correlate.suppress_matched_security(usn, sec)]
    joins = [line.strip(" :+-*") for p in plans for line in p._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert [x for x in joins if "Broadcast" in x and "_bucket" not in x] == []
    assert sum("SortMergeJoin" in x for x in joins) > 20
