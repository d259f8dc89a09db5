"""Fill-in-the-middle against a row-by-row version in plain Python."""

import hashlib
import random
import re

from auditweft.llm.fill_middle import fill_in_middle, restored
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plainly(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    odd = ["a", "é", "𝔘", "\n", "\n\n", "\r\n", " ", "<", "P", ">", "<P", "P>", "\x00", " ", "line\n", "<S"]
    return ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_the_plain_version_and_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(texts(3000, 1))]
    rows += [(-5, None), (None, "a\nb"), (None, None), (7, "a<M>b\nc"), (8, ""), (8, "\n"), (9, "x\n"), (9, "x\n"), (10, "<P>")]
    rows += [(11, "long line " * 400_000), (12, "short\n" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fill_in_middle(docs)
    assert rows_of(out) == sorted((plainly(*r) for r in rows), key=repr)
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t or "")) for i, t in rows)


def test_shares_of_the_forms_are_parameters(spark):
    rows = [(i, f"{i}\nb\nc\n") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_in_middle(docs, seed=3, fim_percent=60, spm_percent=25)
    assert rows_of(out) == sorted((plainly(*r, 3, 60, 25) for r in rows), key=repr)
    forms = {r["form"]: r["count"] for r in out.groupBy("form").count().collect()}
    assert 700 < forms["plain"] < 900 and 220 < forms["spm"] < 380


def test_empty_table_clashing_names_and_text_ids(spark):
    schema = "doc_id string, text string, output int, form int, n string, h1 string"
    assert fill_in_middle(spark.createDataFrame([], schema)).count() == 0
    out = fill_in_middle(spark.createDataFrame([("x", "a\nb\n", 1, 2, "3", "4")], schema))
    assert out.schema["doc_id"].dataType == T.StringType()
    assert rows_of(out) == [plainly("x", "a\nb\n")]
