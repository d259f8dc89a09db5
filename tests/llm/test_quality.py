"""The quadratic discriminant: formulas against numpy, held-out quality on the given tables, odd inputs."""

import numpy as np
import pyarrow as pa
from auditweft.llm import quality
from auditweft.llm.common import read
from auditweft.llm.queries import fold, op12_quality_classifier
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = op12_quality_classifier(spark, SF)
    docs = read(spark, SF, "documents")
    assert got.count() == docs.count()
    rows = got.join(read(spark, SF, "labels").filter("quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97


def moments(x):
    y = np.hstack([x, np.ones((len(x), 1))])
    return y.T @ y


def test_density_difference_equals_the_formula():
    rng = np.random.default_rng(1)
    d = 5
    a, b = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)), 1 + 2 * rng.normal(size=(200, d))
    model = quality.fitted(np.stack([moments(a), moments(b)]), 0.3, 0.1)
    both = np.vstack([a, b])
    za, zb = ((x - both.mean(axis=0)) / both.std(axis=0) for x in (a, b))
    cov = [np.cov(z.T, bias=True) for z in (za, zb)]
    pooled = (300 * cov[0] + 200 * cov[1]) / 500
    x = rng.normal(size=(20, d))
    z = (x - both.mean(axis=0)) / both.std(axis=0)
    out = []
    for own, c in ((za, cov[0]), (zb, cov[1])):
        s = 0.7 * c + 0.3 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        e = z - own.mean(axis=0)
        out.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), out[1] - out[0] + np.log(200 / 300))


def test_statistics_of_a_text_do_not_depend_on_its_batch():
    texts = ["", None, "a", "Word word. word\nnext line\nnext line\n", "ÀÉ &&& 12 !!", "x " * 5000, "\n\n", "né" * 50]
    whole = quality.statistics(pa.array(texts, pa.large_string()))
    assert whole.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.large_string()))[0], whole[i])
    at = dict(zip(quality.STATISTICS, whole[3]))
    assert np.isclose(at["log_words"], np.log1p(7)) and np.isclose(at["distinct_words"], np.log(4.5 / 3.5))
    assert np.isclose(at["distinct_lines"], np.log(2.5 / 1.5))


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "fine text here", 5), (1, "fine text here", 6), (None, None, 7), (2, "", 8), (3, "w " * 200_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, quality int")
    stats = quality.features(docs, F.lit(True))
    model = quality.train(stats, labels)
    assert model == 0.5  # no row has both a text and a label of 0 or 1
    out = quality.score(stats, model).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    assert quality.train(stats, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")) == 1.0
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = {(r["doc_id"], round(r["score"], 9)) for r in quality.score(stats, quality.train(stats, both)).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for _, s in got)
    empty = quality.features(docs.limit(0), ~fold(5, 0))
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
