"""Secret scan: base spans against the plain patterns, added random strings, no Python in the plan."""

import hashlib
import random
import re

from auditweft.llm import secrets
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_and_added_spans(spark):
    rng = random.Random(3)
    pieces = ["Token=", "api_key: '", "secret=short ", "password = ", "AKIA", "ABCDEF0123456789", "deadbeef" * 5, "é😀 ", " ", "plainwords ", ":", "=", '"', "abcdefgh", "passwd=token=abcdefghij"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))), "x") for i in range(400)]
    hexes = "0123456789abcdef"
    rows += [(1000 + i, f"see token={''.join(rng.choice(hexes) for _ in range(40))} for the ordinary identifiers of this description", "x") for i in range(200)]
    lone = "".join(rng.choice("0123456789abcdef") for _ in range(24)) + "-" + "".join(rng.choice("0123456789abcdef") for _ in range(24))
    rows += [(2000, f"look at {lone} here", "x"), (2001, None, "x"), (2002, "", "x"), (None, "token=abcdefgh", "x"), (2000, f"look at {lone} here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = secrets.digest(secrets.scan(df))
    assert "Python" not in found._jdf.queryExecution().toString()
    out = found.collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for doc, t, _ in rows:
        assert by[doc].base_sha256 == hashlib.sha256(plain(t or "").encode()).hexdigest(), t
    assert by[2000].spans == f"markov:8:{8 + len(lone)}"
    assert by[2001].spans == "" and by[None].n_assign == 1


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_score_equals_plain_sums(spark):
    rng = random.Random(6)
    n = len(secrets.ALPHABET) + 1
    table = [round(rng.uniform(-3, 3), 5) for _ in range(n * n)]
    runs = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", secrets.llr(F.col("run"), table).alias("r")).collect()
    for r in got:
        at = [0] + [secrets.ALPHABET.index(c) + 1 for c in r.run]
        assert abs(r.r - sum(table[a * n + b] for a, b in zip(at, at[1:])) / len(r.run)) < 1e-9


def test_unlabelled_secrets_and_ordinary_identifiers(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(docs)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    words = [w for r in docs.orderBy("doc_id").limit(300).collect() for w in re.findall("[a-z]{5,12}", r.text or "")]
    w = lambda: rng.choice(words)
    hidden = [pick(base62, rng.randint(24, 44)) for _ in range(200)] + ["ghp_" + pick(base62, 30) for _ in range(50)] + ["sk-" + pick(base62, 40) for _ in range(50)]
    hidden += [f"{pick('0123456789abcdef', 24)}-{pick('0123456789abcdef', 24)}" for _ in range(50)]
    hidden = [h for h in hidden if re.search("[0-9]", h)]
    plain_ = [f"{w()}_{w()}_{w()}_20{pick('0123456789', 2)}" for _ in range(100)] + [f"{w()}{w().title()}{w().title()}{pick('0123456789', 2)}" for _ in range(100)]
    plain_ += [f"src/{w()}/{w()}/v{pick('0123456789', 1)}/{w()}" for _ in range(100)] + [f"{w()}-{w()}-20{pick('0123456789', 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}" for _ in range(100)]
    rows = [(i, f"see {x} there") for i, x in enumerate(hidden + plain_)]
    got = {r.doc_id: len(r.markov) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit, false = sum(got[i] > 0 for i in range(len(hidden))), sum(got[i] > 0 for i in range(len(hidden), len(rows)))
    print("recall", hit / len(hidden), "false", false / len(plain_), "threshold", model[1])
    assert hit >= 0.95 * len(hidden) and false <= 0.02 * len(plain_)
    # without the model nothing is added
    assert not any(r.markov for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ([0.0] * len(model[0]), 0.0)).collect())
