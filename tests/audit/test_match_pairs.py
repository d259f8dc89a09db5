"""Pairs of journal and security rows against all pairs in plain Python; hot keys cut into cells."""

import random

import pytest
from auditweft.operators import correlate
from auditweft.operators.skew import grid_join, grid_sides
from auditweft.sources.schemas import COLLECTED
from pyspark.sql import functions as F
from test_correlate import journal, security


def key(p):
    return None if p is None or not p.strip() else p.strip().replace("/", "\\").rstrip("\\").lower()


def score(x, y):
    if x is None or y is None:
        return 0
    if x == y:
        return 100
    return 60 if x.rsplit("\\", 1)[-1] == y.rsplit("\\", 1)[-1] else 30 if x in y or y in x else 0


def plainly(rows, window):
    """{(usn, record_id): (score, echo)} over all pairs."""
    out = {}
    for u in (r for r in rows if r.cursor_type == "usn"):
        for s in (r for r in rows if r.cursor_type == "security"):
            if key(s.path) is None or not (s.user or "").strip() or s.user.upper() == "UNKNOWN" or u.server.lower() != s.server.lower():
                continue
            if abs((u.timestamp_utc - s.timestamp_utc).total_seconds()) > window:
                continue
            best = max(score(key(a), key(b)) for a in (u.path, u.previous_path) for b in (s.path, s.previous_path))
            starts = lambda a, b: a.startswith(b) or b.startswith(a)
            empty = [p is not None and not p.strip().replace("/", "\\").rstrip("\\") for p in (u.path, u.previous_path)]
            told = any(empty) or any(key(a) is not None and starts(key(a), key(s.path)) for a in (u.path, u.previous_path))
            if best:
                out[u.usn, s.record_id] = (best, told and s.action in correlate.ECHOES)
    return out


def odd_path(rng):
    if rng.random() < 0.15:
        return rng.choice([None, "", "\\", " ", "\\\\srv\\a", "\\\\srv\\a\\", "a", "A.txt", "d:/a/b"])
    return "\\".join(rng.choice(["a", "B", "ab", "a.txt", "b.txt", "d:", "srv", "", "x y", " "]) for _ in range(rng.randint(1, 6)))


@pytest.mark.parametrize("cell", [5, correlate.CELL])
def test_pairs_equal_all_pairs(spark, cell):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        more = dict(at=rng.randint(0, 150), server=rng.choice(["FS01", "fs01", "FS02"]), previous_path=odd_path(rng) if rng.random() < 0.4 else None)
        if i % 2:
            rows.append(journal(i, odd_path(rng), rng.choice(["modified", "created"]), **more))
        else:
            rows.append(security(i, odd_path(rng), rng.choice(["modified", "deleted", "permission_changed"]), user=rng.choice(["u1", "UNKNOWN", "", "u2"]), **more))
    df = correlate.with_row(spark.createDataFrame(rows, COLLECTED))
    usn, sec = df.filter("cursor_type = 'usn'"), df.filter("cursor_type = 'security'")
    pairs = correlate.match_pairs(usn, sec, 10, cell).groupBy("_row", "record_id").agg(F.max("score").alias("score"), F.max("echo").alias("echo"))
    got = {(r["usn"], r["record_id"]): (r["score"], r["echo"]) for r in pairs.join(usn.select("_row", "usn"), "_row").collect()}
    want = plainly(df.collect(), 10)
    assert len(want) > 500 and got == want


def test_a_burst_on_one_server_splits(spark):
    """A tenth of all rows within ten seconds: no cell holds over a twentieth of the pairs compared."""
    rows = [journal(i, f"D:\\share\\dir\\f{i % 40}.txt", "modified", at=i % 10) for i in range(300)]
    rows += [security(1000 + i, f"D:\\share\\dir\\f{i % 50}.txt", at=i % 10) for i in range(300)]
    rows += [journal(2000 + i, f"D:\\share\\dir\\f{i}.txt", "modified", at=60 * i) for i in range(2700)]
    rows += [security(6000 + i, f"D:\\share\\dir\\f{i}.txt", at=60 * i) for i in range(2700)]
    df = correlate.with_row(spark.createDataFrame(rows, COLLECTED))
    u, s = correlate.match_sides(df.filter("cursor_type = 'usn'"), df.filter("cursor_type = 'security'"), 10)
    on = ["_server", "_slot", "_tag", "_key"]
    a, b = grid_sides(u, s, on, ("_row", "_sec"), cell=60)
    cells = a.groupBy(*on, "_row_cell", "_col_cell").agg(F.count("*").alias("n")).join(b.groupBy(*on, "_row_cell", "_col_cell").agg(F.count("*").alias("m")), [*on, "_row_cell", "_col_cell"])
    most, total = cells.agg(F.max(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m"))).first()
    assert total > 100_000 and most <= 0.05 * total


def test_grid_join_is_an_inner_join(spark):
    left = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("l"))
    right = spark.range(400).select((F.col("id") % 4).alias("k"), F.col("id").alias("r"))
    got = grid_join(left, right, ["k"], ("l", "r"), cell=9)
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    assert grid_join(left.limit(0), right, ["k"], ("l", "r")).count() == 0




def test_best_matches_and_echoes_without_pairs(spark, monkeypatch):
    """Random rows against all pairs; where paths are equal no pair is formed, however many rows share a window."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        more = dict(at=rng.randint(0, 150), server=rng.choice(["FS01", "FS02"]), previous_path=odd_path(rng) if rng.random() < 0.4 else None)
        if i % 2:
            rows.append(journal(i, odd_path(rng), rng.choice(["modified", "created"]), **more))
        else:
            rows.append(security(i, odd_path(rng), rng.choice(["modified", "deleted", "permission_changed"]), user=f"u{i}", **more))
    df = correlate.with_row(spark.createDataFrame(rows, COLLECTED))
    usn, sec = df.filter("cursor_type = 'usn'"), df.filter("cursor_type = 'security'")
    all_rows = df.collect()
    want, at = plainly(all_rows, 10), {r.usn if r.record_id is None else r.record_id: r.timestamp_utc for r in all_rows}
    best = {u: min((-n, abs(at[u] - at[r]), r) for (v, r), (n, _) in want.items() if v == u)[2] for u, _ in want}
    assert {r.usn: int(r.user[1:]) for r in correlate.correlate_feeds(usn, sec, 10).collect() if r.source == "usn-journal+security-log"} == best
    gone = {r for (_, r), (_, echo) in want.items() if echo}
    assert {r.record_id for r in correlate.suppress_matched_security(usn, sec, 10).collect()} == {r.record_id for r in sec.collect()} - gone

    seen, plain = [], correlate.match_pairs
    monkeypatch.setattr(correlate, "match_pairs", lambda *a, **b: seen.append(plain(*a, **b)) or seen[-1])
    dense = [journal(i, "D:\\share\\dir\\f.txt", "modified", at=i % 10) for i in range(400)] + [security(1000 + i, "D:\\share\\dir\\f.txt", at=i % 10) for i in range(400)]
    df = correlate.with_row(spark.createDataFrame(dense, COLLECTED))
    usn, sec = df.filter("cursor_type = 'usn'"), df.filter("cursor_type = 'security'")
    correlate.correlate_feeds(usn, sec, 10), correlate.suppress_matched_security(usn, sec, 10)
    assert len(seen) == 2 and not any(p.count() for p in seen)
