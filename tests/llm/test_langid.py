"""Language identification: chain inference by enumeration, held-out accuracy, odd inputs."""

import itertools

import numpy as np
from auditweft.llm import langid
from auditweft.llm.words import letters_only
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    unary, trans = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    lens = np.array([4, 2, 1])
    mask = np.arange(4)[None] < lens[:, None]
    gamma, pairs, logz = langid.forward_backward(unary, mask, trans)
    total = np.zeros((3, 3))
    for s, n in enumerate(lens):
        scores = {y: sum(unary[s, i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) for y in itertools.product(range(3), repeat=n)}
        z = np.log(sum(np.exp(v) for v in scores.values()))
        assert np.isclose(z, logz[s])
        for i in range(n):
            for k in range(3):
                assert np.isclose(gamma[s, i, k], sum(np.exp(v - z) for y, v in scores.items() if y[i] == k))
        for y, v in scores.items():
            for i in range(n - 1):
                total[y[i], y[i + 1]] += np.exp(v - z)
    assert np.allclose(total, pairs)


def test_pieces_of_a_chain_give_the_whole_chain():
    """Chains of 1 to 700 words with strong weights, in pieces of any size, against one pass over each."""
    rng = np.random.default_rng(5)
    lens = [1, 2, 63, 64, 65, 128, 700, 1]
    rows = np.repeat([0, 2, 3, 4, 5, 7, 8, 9], lens)
    unary, trans = rng.normal(scale=8, size=(len(rows), 4)), rng.normal(scale=3, size=(4, 4))
    want = np.concatenate([langid.forward_backward(unary[rows == r][None], np.ones((1, (rows == r).sum()), bool), trans)[0][0] for r in np.unique(rows)])
    for piece in (1, 3, 64, 1000):
        assert np.allclose(langid.chain_marginals(unary, rows, trans, piece), want, atol=1e-9)


def test_held_out_accuracy_and_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs, ~held, "doc_id", "text", "lang")
    out = langid.identify(docs.filter(held), ~held, model=model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.95
    # words of switched text: runs of held-out documents of two languages, turn by turn
    parts = {x: [w for r in docs.filter(held & (F.col("lang") == x) & F.col("text").isNotNull()).orderBy("doc_id").limit(30).collect() for w in letters_only([v.encode() for v in r.text.split()]) if w] for x in model.labels}
    rng, right, total = np.random.default_rng(1), 0, 0
    for k in range(200):
        a, b = rng.choice(model.labels, 2, replace=False)
        mixed = [(w, x) for x in (a, b, a, b) for at in [int(rng.integers(0, len(parts[x]) - 20))] for w in parts[x][at : at + int(rng.integers(8, 20))]]
        got = langid.word_labels(model, " ".join(w for w, _ in mixed))
        right, total = right + sum(g[1] == x for g, (_, x) in zip(got, mixed)), total + len(mixed)
    print("word accuracy on switched text", right / total, "transitions", model.t.round(2).tolist())
    assert right / total > 0.9
    off = model.t[~np.eye(len(model.labels), dtype=bool)]
    assert off.max() < np.diag(model.t).min() and np.abs(off - off.mean()).max() < 10
    rows = docs.filter("n_chars > 900").orderBy("doc_id").collect()
    de, fr = (next(r.text for r in rows if r.lang == x)[:600] for x in ("de", "fr"))
    odd = spark.createDataFrame([(1, de + "\n" + fr, 9.0), (2, None, 1.0), (3, "", 1.0), (4, "123 !! 4", 1.0), (None, de, 0.0), (1, de + "\n" + fr, 9.0)], "doc_id long, text string, score double")
    got = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(False), model=model).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].shares["de"] > 0.3 and by[1].shares["fr"] > 0.3
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4))
    assert by[None].lang_pred == "de" and by[2].runs == []
    # a long text that switches often: the operator's runs are those of a plain pass over all its words
    long = " ".join(w for k in range(120) for x in rng.permutation(model.labels) for w in parts[x][17 * k % 200 :][: 5 + k % 23])
    labels = [x for _, x in langid.word_labels(model, long)]
    (row,) = langid.identify(spark.createDataFrame([(7, long, None)], "doc_id long, text string, lang string"), F.lit(False), model=model).collect()
    assert len(labels) > 4000 and len(row.runs) > 200
    assert [x for r in row.runs for x in [r.lang] * r.words] == labels


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(one, F.lit(True)).first().lang_pred == "und"
