"""Line dedup against a plain reading of the rule, and odd inputs."""

import random

import pytest

from auditweft.llm.linededup import drop_recurring_lines


def plain(rows, least=5, min_docs=3, similar=0.8, generalise=12):
    """Greedy template parsing in memory: the same rule with dictionaries."""
    masked, seen = {}, {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            t = tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())
            if len(t) >= least:
                masked[(doc, text, no)] = t
                seen.setdefault(t, set()).add((doc, text))
    return masked, seen


def test_exact_and_masked_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = "All rights of this text are reserved"
    numbered = "Page {} of the report from 2024"
    rows = []
    for d in range(40):
        lines = [" ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(6)]
        if d % 2:
            lines.insert(rng.randint(0, 6), common)
        if d % 5 == 0:
            lines.insert(rng.randint(0, 6), numbered.format(d))
        rows.append((d, "\n".join(lines)))
    masked, seen = plain(rows)
    expect = {}
    firsts = {}
    for (doc, text, no), t in sorted(masked.items(), key=lambda x: (x[0][0], x[0][2])):
        firsts.setdefault(t, (doc, no))
    for doc, text in rows:
        keep = []
        for no, line in enumerate(text.split("\n")):
            t = masked.get((doc, text, no))
            if t is None or len(seen[t]) < 3 or firsts[t] == (doc, no):
                keep.append(line)
        expect[doc] = "\n".join(keep)
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == expect
    assert sum(r.n_dropped for r in out) == 19 + 7


def test_long_lines_share_a_template(spark):
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for d in range(6):
        line = list(base)
        line[7 + d] = f"changed{'xyzuvw'[d]}"
        rows.append((d, f"own line {'abcdef'[d]}\n" + " ".join(line)))
    rows.append((9, "quite " + " ".join(base[1:])))
    out = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[d].n_dropped for d in range(6)] == [0, 1, 1, 1, 1, 1]
    assert out[9].n_dropped == 0 and out[9].text == rows[-1][1]
    assert out[3].text == "own line d"


def test_odd_rows_and_clashing_columns(spark):
    line = "one two three four five six"
    rows = [(1, line, "x", 1), (1, line, "x", 1), (None, line, None, 2), (2, None, "y", 3), (3, "", "y", 4), (4, line, "z", 5), (5, line + "\n", "z", 6)]
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, key string, line long"))
    assert out.columns[:4] == ["doc_id", "text", "key", "line"]
    got = sorted((r.doc_id or 0, "~" if r.text is None else r.text, r.n_dropped) for r in out.collect())
    assert got == [(0, line, 0), (1, "", 1), (1, "", 1), (2, "~", 0), (3, "", 0), (4, "", 1), (5, "", 1)]


def test_columns_named_like_the_operators_own(spark):
    line = "one two three four five six"
    rows = [(d, line, "a", "b", "c", "d", 9) for d in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string, _id string, _FP string, _gone string, n_dropped long")
    out = drop_recurring_lines(df, dropped_col="gone_lines").collect()
    assert sorted((r.doc_id, r.text, r._own, r._id, r._FP, r._gone, r.n_dropped, r.gone_lines) for r in out) == [(d, line if d == 0 else "", "a", "b", "c", "d", 9, int(d > 0)) for d in range(4)]
    with pytest.raises(ValueError, match="n_dropped"):
        drop_recurring_lines(df)


def test_empty_table(spark):
    assert drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_leaf(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    line = "this page was written by {} for all readers of the daily news of our town".format
    rows = [(d, line(word()) + "\nown " + " ".join(word() for _ in range(3))) for d in range(5000)]
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.filter("n_dropped = 1").collect()} == set(range(1, 5000))
    # as many lines that begin alike and share nothing else stay
    rows = [(d, "this page was " + " ".join(word() for _ in range(12))) for d in range(5000)]
    assert drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").count() == 0


def test_lines_of_one_document_count_once(spark):
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    alike = lambda k: " ".join(w if i != 7 else f"changed{k}" for i, w in enumerate(base))
    own = lambda k: alike(k).replace("wa", "va")
    rows = [(1, "\n".join(map(alike, "xyz"))), (2, "\n".join(map(own, "xyz"))), (3, own("u")), (4, own("v"))]
    out = {r.doc_id: r.n_dropped for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 2, 3: 1, 4: 1}
