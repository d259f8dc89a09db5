"""Toxicity: gradients by finite differences, held-out quality, odd inputs."""

import numpy as np
from auditweft.llm import gru, toxicity
from auditweft.llm.words import letters_only
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_gradients_equal_finite_differences():
    net = gru.Network(3, np.float64)
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "réeuxch", ""]
    at = rng.integers(0, 5, (3, 4))
    mask = np.arange(4)[None] < np.array([4, 2, 3])[:, None]
    y, w = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 1.0])
    _, grad = net.gradients(words, at, mask, y, w)
    for name, p in net.p.items():
        places = np.argsort(-np.abs(grad[name]).ravel())[:4]
        for i in places:
            i = np.unravel_index(i, p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = net.gradients(words, at, mask, y, w)[0]
            p[i] = old - 1e-5
            down = net.gradients(words, at, mask, y, w)[0]
            p[i] = old
            assert np.isclose((up - down) / 2e-5, grad[name][i], rtol=1e-3, atol=1e-7), name


def test_windows_overlap_and_cover():
    owner, begin, size = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    assert owner.tolist() == [0, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4]
    assert size[owner == 3].tolist() == [32, 17] and begin[owner == 3].tolist() == [33, 49]
    covered = set()
    for b, s in zip(begin[owner == 4], size[owner == 4]):
        covered |= set(range(b, b + s))
    assert covered == set(range(66, 166))


def test_held_out_quality_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(docs, labels, ~held)
    out = toxicity.score(docs.filter(held), model).join(labels, "doc_id").toPandas()
    s, y = out.score.to_numpy(), out.toxic.to_numpy()
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    flagged = s >= 0.7
    print("auc", auc, "recall", flagged[y == 1].mean(), "precision", y[flagged].mean(), "flagged clean", flagged[y == 0].mean())
    assert auc > 0.96 and flagged[y == 1].mean() > 0.85 and y[flagged].mean() > 0.85
    words = np.array([len((t or "").split()) for t in docs.join(out_ids(spark, out), "doc_id").toPandas().set_index("doc_id").loc[out.doc_id].text])
    for lo, hi in ((0, 640), (641, 10**9)):
        some = (words >= lo) & (words <= hi)
        print("words", lo, "texts", some.sum(), "recall", flagged[some & (y == 1)].mean(), "flagged clean", flagged[some & (y == 0)].mean())
        assert flagged[some & (y == 1)].mean() > 0.8 and flagged[some & (y == 0)].mean() < 0.05
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "123 .. !!", 1.0), (None, "you idiot", 1.0), (4, "word " * 50_000, 0.0), (4, "word " * 50_000, 0.0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    # document scores against a plain pass over the windows of each text, one window at a time
    for r in docs.filter("n_chars < 4000").orderBy("doc_id").limit(40).collect():
        words = letters_only([w.encode() for w in (r.text or "").split()])
        logit = []
        for a in [*range(0, max(1, len(words) - 16), 16)] if len(words) > 32 else [0]:
            part = words[a : a + 32]
            at = np.arange(len(part))[None]
            logit.append(model.net.logits(model.net.word_rows(part), at, at >= 0)[0] if part else 0.0)
        x = [np.clip(max(logit), -12, 12) / 4, 4 * np.mean(gru.sigmoid(np.array(logit))), np.log(len(logit)) / 3, 1]
        want = gru.sigmoid(np.array(x) @ model.layer) if any(words) else 0.0
        mine = toxicity.score(docs.filter(F.col("doc_id") == r.doc_id), model).first().score if r.doc_id % 8 == 0 else None
        assert mine is None or abs(mine - want) < 1e-3


def out_ids(spark, out):
    return spark.createDataFrame([(int(i),) for i in out.doc_id], "doc_id long")


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert model is None and toxicity.score(docs, model).first().score == 0
