"""Toxicity scores of whole texts from a bidirectional gated recurrent network over word windows.

All overlapping windows of a text are scored (32 words, every 16). The network is trained in numpy
on windows of labelled documents, by multiple-instance learning: a toxic document vouches for its
highest windows only, a clean one for all. A logistic layer over the highest, the mean and the
number of windows is calibrated on whole texts of labelled documents left out of that training.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, persisted, slices
from .gru import BUCKETS, HID, Network, inputs_of, sigmoid
from .textnum import raw_bytes, word_bounds
from .words import WordTable, letters_only

WINDOW, STRIDE = 32, 16


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first word, words) of the overlapping windows of texts with so many words each."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(counts) - counts, n) + k * STRIDE
    return owner, begin, np.clip(counts[owner] - k * STRIDE, 0, WINDOW)


def _places(begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)
    mask = t[None] < size[:, None]
    at = np.where(mask, begin[:, None] + t, 0)
    return np.where(mask, rows[np.minimum(at, max(0, len(rows) - 1))] if len(rows) else 0, 0), mask


class Scorer:
    def __init__(self, net: Network, layer: np.ndarray):
        self.net, self.layer = net, layer
        self.name = f"toxicity {uuid.uuid4().hex}"  # the same in every task, unlike the object

    def _rows(self, words: list[str]) -> np.ndarray:
        return np.column_stack([self.net.word_rows(words), np.array([w != "" for w in words], np.float32)])

    def texts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(features of each whole text from all its windows, whether it has a letter)."""
        out, lettered = np.empty((len(col), 4)), np.zeros(len(col), bool)
        table = held(self.name, lambda: WordTable(self._rows))
        for a, b in slices(col, 1 << 19):
            data, bounds = raw_bytes(col.slice(a, b - a))
            starts, ends, rows = word_bounds(data, bounds)
            known, word = table.index(data, starts, ends) if len(starts) else (np.zeros((1, 6 * HID + 1), np.float32), np.zeros(0, np.int64))
            lettered[a + rows[known[word, -1] > 0]] = True
            owner, begin, size = windows(np.bincount(rows, minlength=b - a))
            logit = np.empty(len(owner))
            for lo in range(0, len(owner), 2048):
                at, mask = _places(begin[lo : lo + 2048], size[lo : lo + 2048], word)
                logit[lo : lo + 2048] = self.net.logits(known[:, :-1], at, mask)
            out[a:b] = self.documents(logit, owner, b - a)
        return out, lettered

    def documents(self, logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Features of each text: highest and mean window probability logit, number of windows."""
        top = np.full(n, -30.0)
        np.maximum.at(top, owner, logit)
        count = np.maximum(1, np.bincount(owner, minlength=n))
        mean = np.bincount(owner, sigmoid(logit), n) / count
        return np.column_stack([np.clip(top, -12, 12) / 4, mean * 4, np.log(count) / 3, np.ones(n)])


def _fit_layer(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        hess = (x * (w * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + ridge * np.eye(len(b))
        b -= np.clip(np.linalg.solve(hess, x.T @ (w * (p - y)) + ridge * b), -2, 2)
    return b


def fit(texts: list[str], y: np.ndarray, epochs: int = 5, batch: int = 256, seed: int = 5) -> Network:
    """Train on whole texts of words parted by blanks (_: no letters)."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {"": 0}
    parts = [np.array([vocab.setdefault(w if w != "_" else "", len(vocab)) for w in t.split()], np.int64) for t in texts]
    flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    words = list(vocab)
    owner, begin, size = windows(counts)
    at, mask = _places(begin, size, flat.astype(np.int32))
    net = Network(seed)
    _seed_embeddings(net, words, flat, np.repeat(np.arange(len(texts)), counts), y)
    for epoch in range(epochs):
        rows = net.word_rows(words)
        logit = np.concatenate([net.logits(rows, at[a : a + 1024], mask[a : a + 1024]) for a in range(0, len(at), 1024)])
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], side="left")
        pos = order[(rank < 2) & (y[owner[order]] == 1)]
        neg = order[((rank < 2) | (rng.random(len(order)) < 0.05)) & (y[owner[order]] == 0)]
        pick = rng.permutation(np.concatenate([pos, neg]))
        heavy = min(8.0, max(1.0, len(neg) / max(1, len(pos))))
        for part in np.array_split(pick, max(1, len(pick) // batch)):
            if not len(part):
                continue
            used, local = np.unique(at[part], return_inverse=True)
            target = y[owner[part]].astype(net.p["w"].dtype)
            _, grad = net.gradients([words[i] for i in used], local.reshape(at[part].shape), mask[part], target, np.where(target == 1, heavy, 1.0).astype(net.p["w"].dtype))
            net.step(grad, 0.05 if epoch < 3 else 0.02)
    net.seen.clear()  # not needed any more; it would travel to every task
    return net


def _seed_embeddings(net: Network, words: list[str], flat: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
    """Starts the first input dimension at the shrunken log-odds of each bucket over training texts."""
    toxic = max(1, int((y == 1).sum()))
    clean = max(1, int((y == 0).sum()))
    seen = np.zeros((2, 3, BUCKETS), np.int64)
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))
    lo = 0
    while lo < len(doc):  # some texts at a time: their n-grams fit in memory
        hi = int(max(ends[min(np.searchsorted(ends, lo + 16_384), len(ends) - 1)], lo + 1))
        pair = np.unique(doc[lo:hi] * np.int64(len(words)) + flat[lo:hi])
        own, word = pair // len(words), pair % len(words)
        used, local = np.unique(word, return_inverse=True)
        for k, (ids, first) in enumerate(inputs_of([words[w] for w in used])):
            n = np.diff(np.append(first, len(ids)))
            size = n[local]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            bucket = ids[np.repeat(first[local], size) + inner]
            both = np.unique(np.repeat(own, size) * BUCKETS + bucket)
            lab, b = y[both // BUCKETS], both % BUCKETS
            for label in (0, 1):
                seen[label, k] += np.bincount(b[lab == label], minlength=BUCKETS)
        lo = hi
    for k in range(3):
        c, t = seen[:, k]
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        net.p["emb"][k, :, 0] = np.clip(odds * (t + c) / (t + c + 6.0), -1, 4) / 2


def train(
    docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_label: int = 1500, train_words: int = 2560
) -> Scorer | None:
    """Fit on about ``docs_per_label`` labelled documents per label, at most three times as many in all,
    chosen by a hash of the id among the rows where ``rows`` holds. None if a label is missing.

    One in five is left out of the network's training: its whole text, of whatever length, calibrates
    the layer, where each clean text stands for its share of all clean ones. Of the others those of
    up to ``train_words`` words teach the network, with all their windows.
    """
    lab = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    own = docs.filter(rows).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    chosen = lab.withColumn("_h", F.xxhash64("_id", F.lit(23)))
    counts = {r["_y"]: r["count"] for r in lab.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return None
    rate = {k: min(1, 1.5 * docs_per_label / v) for k, v in counts.items()}
    share = F.when(F.col("_y") == 1, F.lit(int(1e6 * rate[1]))).otherwise(F.lit(int(1e6 * rate[0])))
    chosen = chosen.filter(F.pmod("_h", F.lit(1_000_000)) <= share).orderBy("_h").limit(3 * docs_per_label)  # so many rows at any size
    out = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(5)) == 0
    sample = persisted(own.join(F.broadcast(chosen), "_id").select("_y", "_h", out.alias("_out"), "t"), "labelled")

    def short(batches):
        for batch in batches:
            words = [letters_only([w.encode() for w in t.split()]) for t in batch.column(2).to_pylist()]
            keep = pa.array([i for i, w in enumerate(words) if 0 < len(w) <= train_words], pa.int64())
            text = [" ".join(w or "_" for w in words[i]) for i in keep.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(text, pa.string())], names=["y", "h", "words"])

    got = sample.filter("not _out").select("_y", "_h", "t").mapInArrow(short, "y int, h long, words string").orderBy("h", "y").limit(3 * docs_per_label).collect()
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    model = Scorer(fit([r["words"] for r in got], y), np.zeros(4))

    def measure(batches):
        for batch in batches:
            x, lettered = model.texts(batch.column(1))
            keep = pa.array(np.flatnonzero(lettered))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), *(pa.array(c[lettered]) for c in x.T)], names=["y", "a", "b", "c", "d"])

    def measured(rows: DataFrame) -> np.ndarray:
        found = rows.select("_y", "t").mapInArrow(measure, "y int, a double, b double, c double, d double")
        return np.array([tuple(r) for r in found.orderBy("y", "a", "b", "c").limit(3 * docs_per_label).collect()], float).reshape(-1, 5)

    seen = measured(sample.filter("_out"))
    if len(set(seen[:, 0])) < 2:  # too few texts to leave any out
        seen = measured(sample)
    y = seen[:, 0]
    model.layer = _fit_layer(seen[:, 1:], y, np.where(y == 0, rate[1] / rate[0], 1.0))
    return model


def scored(docs: DataFrame, model: Scorer | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text appended; all rows and columns are kept.

    A text that is null or has no letter scores 0, and so does every text without a model.
    """
    own = docs.withColumn(text_col, F.col(text_col).cast("string"))
    fields = [f for f in own.schema.fields if f.name != out_col]
    own = own.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)))  # whatever the names
    place = [f.name for f in fields].index(text_col)

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model is not None:
                x, lettered = model.texts(batch.column(place))
                out = np.where(lettered, sigmoid(x @ model.layer), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*(f.name for f in fields), out_col])

    return own.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.DoubleType())]))


def score(docs: DataFrame, model: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score (0 to 1, higher: likelier toxic), over all overlapping windows.

    Words are what white space parts, reduced to lower-case letters. A text that is null, empty or
    without a letter scores 0. Null ids and repeated rows are scored like others; other columns are
    ignored; an empty table gives an empty result. Without a model (a label was missing) the score is 0.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(own, model).select("doc_id", "score")
