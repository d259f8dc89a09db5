"""Echo rules against a plain reading of them, row by row."""

import random

from auditweft.operators import timeline
from auditweft.sources.schemas import EVENT
from test_timeline import FIELDS, event

MADE = ("created", "created_or_appended")
TURNED = ("renamed", "moved")


def kept(rows, scale=1.0):
    """ids that stay; rows are (id, at, action, path, previous path) below the root, paths in lower case."""
    kind = lambda p: {"new text document.txt": "text", "new microsoft excel worksheet.xlsx": "excel"}.get(p.rsplit("\\", 1)[-1])
    fresh_name = lambda p: bool(kind(p)) or p.rsplit("\\", 1)[-1] == "new folder"
    up = lambda p: p.rsplit("\\", 1)[0] if "\\" in p else ""
    out = set()
    for i, at, action, p, q in rows:
        others = [r for r in rows if r[0] != i]
        near = lambda s, test: any(abs(t - at) <= s * scale and test(a, x, y) for _, t, a, x, y in others)  # noqa: B023, E731
        gone = action == "deleted" and near(15, lambda a, x, y: a in TURNED and y == p)
        if action == "moved" and q and up(q).startswith(up(p) + "\\"):
            gone |= near(30, lambda a, x, y: a == "deleted" and x == q) and not near(8, lambda a, x, y: a != "deleted" and x == p)
        if action in ("changed", "modified"):
            gone |= "." not in p.rsplit("\\", 1)[-1] and near(30, lambda a, x, y: a == "moved" and up(x) == p)
            gone |= near(15, lambda a, x, y: a in (*TURNED, *MADE, "deleted") and p in (x, y))
        if action in MADE:
            gone |= near(15, lambda a, x, y: a in TURNED and x == p)
            if fresh_name(p):
                gone |= near(45, lambda a, x, y: a in ("created", *TURNED) and up(x) == up(p) and (not fresh_name(x) or bool(y and kind(p) and kind(y) == kind(p))))
        if action in TURNED and q and fresh_name(q):
            gone |= near(15, lambda a, x, y: a in MADE and x == p)
        if not gone:
            out.add(i)
    return out


def test_equal_to_a_plain_reading(spark):
    rng = random.Random(11)
    names = ["a.txt", "b.txt", "c", "New Text Document.txt", "New Microsoft Excel Worksheet.xlsx", "New Folder"]
    folders = ["d", "d\\c", "d\\c\\e", "f"]
    dropped = 0
    for trial in range(4):
        rows = []
        for i in range(400):
            action = rng.choice([*MADE, *TURNED, "deleted", "changed", "modified", "accessed"])
            pick = lambda: f"{rng.choice(folders)}\\{rng.choice(names)}"
            rows.append((str(i), float(rng.randint(0, 500 * (trial + 1))), action, pick(), pick() if action in TURNED and rng.random() < 0.9 else None))
        df = spark.createDataFrame([event(i, a, p, at, previous_path=q) for i, at, a, p, q in rows], EVENT)
        got = {r.id for r in timeline.suppress_echoes(df).collect()}
        want = kept([(i, at, a, ("r\\" + p).lower(), ("r\\" + q).lower() if q else "") for i, at, a, p, q in rows])
        assert got == want
        dropped += len(rows) - len(want)
    assert 200 < dropped < 1400


def test_odd_rows(spark):
    rows = [event(1, "deleted", "d\\a.txt", 0), event(1, "deleted", "d\\a.txt", 0), event(2, "renamed", "d\\b.txt", 15, previous_path="d\\a.txt"), event(3, None, "d\\b.txt", 15)]
    rows.append(tuple(None if f == "path" else v for f, v in zip(FIELDS, event(4, "modified", "x", 1))))
    assert sorted(r.id for r in timeline.suppress_echoes(spark.createDataFrame(rows, EVENT)).collect()) == ["2", "3", "4"]
    assert timeline.suppress_echoes(spark.createDataFrame([], EVENT)).count() == 0
    late = [event(1, "deleted", "d\\a.txt", 0), event(2, "renamed", "d\\b.txt", 15.000001, previous_path="d\\a.txt")]
    assert timeline.suppress_echoes(spark.createDataFrame(late, EVENT)).count() == 2
