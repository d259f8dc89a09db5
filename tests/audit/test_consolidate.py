"""Timeline consolidation against a plain newest-first pass over each whole share."""

import random
from datetime import timedelta

import pandas as pd
from auditweft.operators import timeline
from auditweft.operators.components import components
from auditweft.sources.schemas import EVENT
from test_timeline import event

TURNED, CREATED, CHANGED = {"renamed", "moved"}, {"created", "created_or_appended"}, {"changed", "modified"}
FRESH = ("new text document.txt", "new folder")


def leaf(p):
    return p.rsplit("\\", 1)[-1]


def parent(p):
    return p.rsplit("\\", 1)[0].lower()


def newest_first(rows, window=15):
    """{id: (action, previous path, shown name)} of rows that stay; every row looks at all rows of its share."""
    rows = sorted(rows, key=lambda r: (-r.timestamp_utc.timestamp(), r.id))
    used, emitted, out = set(), set(), {}
    fresh = lambda p: bool(p) and leaf(p).lower() in FRESH
    paths = lambda r: {r.path.lower()} | ({r.previous_path.lower()} if r.previous_path else set())
    noise = lambda r: any(p and (leaf(p).startswith("~$") or p.lower().endswith(".tmp")) for p in (r.path, r.previous_path))
    journal = lambda r: "usn-journal" in r.source

    def redundant(c, near, wide):
        a, p, dot = c.action, c.path.lower(), "." in leaf(c.path)
        if fresh(c.path) and (a in CREATED or any(parent(e.path) == parent(c.path) and not fresh(e.path) and e.action in TURNED | CREATED | CHANGED | {"deleted"} for e in wide)):
            return True
        if a == "renamed" and fresh(c.previous_path) and any(e.action in CREATED and e.path.lower() == p for e in wide):
            return True
        if a in CREATED | {"deleted"} and any(e.action in TURNED | {"created"} and p in paths(e) for e in near):
            return True
        if not dot and any("." in leaf(e.path) and parent(e.path) == p for e in near):
            return True
        if a == "created_or_appended" and c.source == "windows-security-log" and any(e.user == c.user and e.action in CHANGED | {"deleted", "renamed"} and parent(e.path) == p for e in near):
            return True
        if a in CHANGED and c.source == "usn-journal" and c.user == "UNKNOWN" and any(e.path.lower() == p and e.source != "usn-journal" and e.action not in CHANGED for e in near):
            return True
        return a in CHANGED and journal(c) and any(
            p in paths(e) and (e.action in TURNED | {"deleted"} or e.action in CREATED and "." in leaf(e.path) or e.action in CHANGED and journal(e) and e.timestamp_utc > c.timestamp_utc) for e in near
        )

    for c in rows:
        if c.id in used:
            continue
        if noise(c):
            used.add(c.id)
            continue
        wide = [e for e in rows if e.id != c.id and (e.server, e.share) == (c.server, c.share) and abs(e.timestamp_utc - c.timestamp_utc) <= timedelta(seconds=window)]
        near = [e for e in wide if e.id not in used]
        src = "usn" if journal(c) else c.source
        second = c.timestamp_utc.replace(microsecond=0)
        if c.previous_path and c.action in TURNED and ("." in leaf(c.path)) == ("." in leaf(c.previous_path)):
            for e in near:
                same = (e.path.lower(), (e.previous_path or "").lower()) == (c.path.lower(), c.previous_path.lower()) if e.action in TURNED else bool(paths(e) & paths(c))
                if same and not noise(e):
                    used.add(e.id)
            used.add(c.id)
            was = fresh(c.previous_path)
            final = "created" if was else "moved" if parent(c.path) != parent(c.previous_path) else "renamed"
            emitted.add((c.server, c.share, second, c.user, src, final, c.path.lower(), "" if was else c.previous_path.lower()))
            out[c.id] = (final, None if was else c.previous_path, leaf(c.path))
            continue
        used.add(c.id)
        key = (c.server, c.share, second, c.user, src, "changed" if c.action in CHANGED else c.action, c.path.lower(), (c.previous_path or "").lower())
        if not redundant(c, near, wide) and key not in emitted:
            emitted.add(key)
            out[c.id] = (c.action, c.previous_path, None if c.action == "accessed" else leaf(c.path))
    return out


def some_rows(seed, n, step):
    rng = random.Random(seed)
    actions = ["renamed", "moved", "created", "created_or_appended", "changed", "modified", "deleted", "accessed"]
    names = ["a.txt", "B.txt", "c", "d1\\a.txt", "d1\\e.txt", "d1", "d2", "d2\\New Text Document.txt", "d1\\New Text Document.txt", "~$a.txt", "x.tmp", "d2\\a.txt", "d2\\New Folder", "d1\\d3\\z.doc"]
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 0, 0.4, 1, 3, step])
        action = rng.choice(actions)
        kw = dict(source=rng.choice(["usn-journal", "windows-security-log", "usn-journal+security-log"]), user=rng.choice(["ana", "bo", "UNKNOWN"]), share=rng.choice(["Dados", "RH"]))
        if action in TURNED and rng.random() < 0.8:
            kw["previous_path"] = rng.choice(names)
        rows.append(event(i, action, rng.choice(names), at, **kw))
    return rows


def test_equals_the_plain_pass(spark):
    for seed, n, step in ((1, 350, 14), (2, 300, 40)):
        df = spark.createDataFrame(some_rows(seed, n, step), EVENT)
        got = {r.id: (r.action, r.previous_path, r.display_target) for r in timeline.timeline_consolidate(df).collect()}
        want = newest_first(df.collect())
        assert 50 < len(want) < n and got == want


def test_a_share_that_is_never_quiet_splits(spark):
    rows = [event(i, "modified", f"d{i % 50}\\f{i % 200}.txt", i * 2.0) for i in range(2000)]
    df = spark.createDataFrame(rows, EVENT)
    own = df.selectExpr("id", "server", "share", "action", "source", "unix_micros(timestamp_utc) us", "lower(path) p", "'' q", "substring_index(lower(path), '\\\\', 1) pp", "true dot", "false prov")
    sizes = timeline._touching(own, 15).groupBy("_s").count().collect()
    assert len(sizes) >= 200 and max(r["count"] for r in sizes) <= 10
    assert timeline.timeline_consolidate(df).count() == 2000


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 900), (900, 950), (7, 7), (2000, 2001), (2000, 2001)] + [(5000, 5001 + i) for i in range(100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000: 900, 900: 900, 950: 900, 2000: 2000, 2001: 2000} | {5000 + i: 5000 for i in range(101)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0




def test_small_components_share_frames():
    row = dict(user="u", source="usn-journal", action="deleted", previous_path=None, us=0, q="", pp="d:", qp="", dot=True, qdot=False, prov=False, qprov=False, noise=False, src="usn", root=False)
    rows = pd.DataFrame([row | dict(id=str(i), p=f"d:\\f{i}.txt", leaf=f"f{i}.txt", _s=i) for i in range(3000)])
    frames = list(timeline._consolidator(15_000_000)(iter([rows])))
    assert len(frames) == 1 and len(frames[0]) == 3000
