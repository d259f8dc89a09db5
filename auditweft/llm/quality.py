"""Document quality by a regularised quadratic discriminant.

Every text becomes a row of transformed statistics (shares on a log-odds scale, counts on a log
scale), computed once and stored. Each class has a Gaussian whose covariance is shrunk towards the
pooled one and towards a sphere. A text's score is the difference of the two log densities, each a
Mahalanobis distance by a cached Cholesky factor, mapped to a probability by a logistic curve.

Training has no sample: class sums and cross products are added up in the tasks over all labelled
rows, the shrinkage is chosen by the log loss of each part under models of the other parts, and the
curve is fitted to counts of labels by score bins. Only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from .common import persisted, slices
from .textnum import raw_bytes, word_bounds, word_hashes

#: Candidate shrinkages: towards the pooled covariance, and towards a sphere of the same trace.
TO_POOLED = (0.0, 0.1, 0.3, 0.6)
TO_SPHERE = (0.001, 0.01, 0.1)
PARTS = 4
_SLICE = 2 << 20
#: Bins of the score difference when the logistic curve is fitted.
_BINS, _SPAN = 2000, 12.0

_KINDS = np.full(256, 6, np.uint8)  # 6: other symbols
_KINDS[97:123] = 0
_KINDS[65:91] = 1
_KINDS[128:] = 2  # letters beyond ASCII, bytewise
_KINDS[48:58] = 3
_KINDS[[32, *range(9, 14)]] = 4
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 5

STATISTICS = [
    "log_chars", "log_words", "log_lines", "word_mean", "word_sd", "word_longest", "upper", "beyond", "digit", "space", "mark", "symbol",
    "words_with_symbol", "words_upper", "words_capital", "words_without_letter", "words_short", "words_long", "words_ended", "distinct_words",
    "top_word", "same_next", "distinct_pairs", "distinct_runs", "distinct_lines", "byte_entropy", "line_mean", "same_byte",
]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on a log-odds scale, half a case added to either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _ranges(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct values and the count of the most frequent one."""
    if not len(values):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
    at = np.flatnonzero(new)
    often = np.diff(np.concatenate([at, [len(v)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], often)
    return np.bincount(r[at], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text (null: empty)."""
    data, bounds = raw_bytes(texts)
    n = len(bounds) - 1
    kind = _KINDS[data]
    size = np.diff(bounds)
    chars = _ranges((data & 0xC0) != 0x80, bounds)
    count = [_ranges(kind == k, bounds) for k in range(7)]
    starts, ends, rows = word_bounds(data, bounds)
    length = ends - starts
    words = np.bincount(rows, minlength=n)
    total = np.bincount(rows, weights=length, minlength=n)
    square = np.bincount(rows, weights=length.astype(np.float64) ** 2, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    some = np.maximum(words, 1)
    mean = total / some
    inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.stack([starts, ends])], axis=0)[0]
    lower, upper, letters = inside(kind == 0), inside(kind == 1), inside(kind <= 2)
    symbols = inside(kind == 6)
    per = lambda flags: np.bincount(rows[flags], minlength=n)
    hashes = word_hashes(data, starts, ends)
    distinct, top = _distinct(hashes, rows, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    pair = hashes[1:] * np.uint64(3) + hashes[:-1] if len(hashes) > 1 else hashes[:0]
    in_pair = rows[1:] == rows[:-1]
    pairs = np.bincount(rows[1:][in_pair], minlength=n)
    d_pairs, _ = _distinct(pair[in_pair], rows[1:][in_pair], n)
    far = 5
    run = hashes[far:] * np.uint64(5) + hashes[:-far] + np.uint64(7) * hashes[2 : len(hashes) - far + 2] if len(hashes) > far else hashes[:0]
    in_run = rows[far:] == rows[:-far]
    runs = np.bincount(rows[far:][in_run], minlength=n)
    d_runs, _ = _distinct(run[in_run], rows[far:][in_run], n)
    breaks = data == 10
    lines = _ranges(breaks, bounds) + 1
    cut = np.unique(np.concatenate([bounds[:-1], bounds[1:], np.flatnonzero(breaks), np.flatnonzero(breaks) + 1]))
    cut = cut[cut <= len(data)]
    l_start, l_end = cut[:-1], cut[1:]
    keep = (l_end > l_start) & ~breaks[l_start] if len(l_start) else np.zeros(0, bool)
    l_start, l_end = l_start[keep], l_end[keep]
    l_rows = np.searchsorted(bounds, l_start, side="right") - 1
    filled = np.bincount(l_rows, minlength=n)
    d_lines, _ = _distinct(word_hashes(data, l_start, l_end), l_rows, n)
    bytes_row = np.repeat(np.arange(n), size)
    seen = np.bincount(bytes_row * 256 + data, minlength=n * 256).reshape(n, 256)
    p = seen / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & (bytes_row[1:] == bytes_row[:-1])
    return np.column_stack([
        np.log1p(chars), np.log1p(words), np.log1p(lines), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square / some - mean**2, 0))), np.log1p(longest),
        _share(count[1], size), _share(count[2], size), _share(count[3], size), _share(count[4], size), _share(count[5], size), _share(count[6], size),
        _share(per(symbols > 0), words), _share(per((upper > 1) & (lower == 0)), words), _share(per((upper == 1) & (lower > 0)), words),
        _share(per(letters == 0), words), _share(per(length <= 3), words), _share(per(length >= 12), words),
        _share(per(kind[np.maximum(ends - 1, 0)] == 5), words), _share(distinct, words),
        _share(top, words), _share(per(same), words), _share(d_pairs, pairs), _share(d_runs, runs), _share(d_lines, filled), entropy,
        np.log1p(chars / lines), _share(_ranges(twice, bounds), size),
    ])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        for a, b in slices(text, _SLICE):
            x = statistics(text[a:b]).astype(np.float32)
            rest = {c: batch.column(c)[a:b] for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(rest | {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))})


def features(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learn, part, x: the statistics of every text, stored; part deals ids out for the choice of shrinkage."""
    kinds = StructType().add("doc_id", docs.schema[id_col].dataType).add("learn", "boolean").add("part", "integer").add("x", ArrayType(FloatType()))
    part = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("part")), F.lit(PARTS)).cast("int")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), part.alias("part"), F.col(f"`{text_col}`").alias("text"))
    return persisted(source.mapInArrow(_featured, kinds), "statistics")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (label, part) of the task: n, sums and cross products as one matrix with a column of ones."""
    d = len(STATISTICS) + 1
    sums = np.zeros((2 * PARTS, d, d))
    for batch in batches:
        x = np.hstack([_matrix(batch), np.ones((batch.num_rows, 1))])
        key = batch.column("label").to_numpy() * PARTS + batch.column("part").to_numpy()
        for k in np.unique(key):
            own = x[key == k]
            sums[k] += own.T @ own
    for k in range(2 * PARTS):
        if sums[k, -1, -1]:
            yield pa.RecordBatch.from_pydict({"key": pa.array([k] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "m": pa.array(list(sums[k]), pa.list_(pa.float64()))})


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the inverse-free form, log determinants, prior and curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverse of the lower Cholesky factor, per class
    logs: np.ndarray  # log determinant of the covariance, per class
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the log odds of the prior."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) - 0.5 * self.logs[c] for c in (0, 1)]
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * _squeezed(self.difference(x)) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _squeezed(d: np.ndarray) -> np.ndarray:
    """Differences grow with the number of statistics; on this scale a logistic curve fits them."""
    return np.arcsinh(d)


def fitted(sums: np.ndarray, to_pooled: float, to_sphere: float) -> Discriminant:
    """The discriminant of two classes' cross products (with a last column of ones)."""
    d = sums.shape[1] - 1
    n = np.maximum(sums[:, d, d], 1)
    both = sums.sum(axis=0)
    centre = both[:d, d] / both[d, d]
    scale = np.sqrt(np.maximum(np.diag(both)[:d] / both[d, d] - centre**2, 1e-8))
    means, spread = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        mean = sums[c, :d, d] / n[c]
        means[c] = (mean - centre) / scale
        spread[c] = (sums[c, :d, :d] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    factors, logs = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        s = (1 - to_pooled) * spread[c] + to_pooled * pooled
        s = (1 - to_sphere) * s + to_sphere * max(np.trace(s) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(s)
        factors[c] = np.linalg.solve(lower, np.eye(d))
        logs[c] = 2 * np.log(np.diag(lower)).sum()
    return Discriminant(centre, scale, means, factors, logs, float(np.log(n[1] / n[0])))


def _binned(models: dict[tuple[int, int], Discriminant]):
    """Counts by (candidate, bin, label): each part is scored by the models of the other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            x, part, label = _matrix(batch), batch.column("part").to_numpy(), batch.column("label").to_numpy()
            for (which, own), model in models.items():
                at = part == own
                if at.any():
                    s = _squeezed(model.difference(x[at]))
                    cell = (np.clip((s + _SPAN) / (2 * _SPAN), 0, 1 - 1e-9) * _BINS).astype(np.int64) * 2 + label[at]
                    counts.setdefault(which, np.zeros(2 * _BINS, np.int64))
                    counts[which] += np.bincount(cell, minlength=2 * _BINS)
        for which, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"which": pa.array([which] * len(some), pa.int32()), "cell": pa.array(some.astype(np.int32)), "n": pa.array(c[some])})

    return run


def _curve(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and log loss a row of the logistic curve that fits counts by (bin, label) best."""
    s = (np.arange(_BINS) + 0.5) / _BINS * 2 * _SPAN - _SPAN
    zero, one = counts[0::2].astype(float), counts[1::2].astype(float)
    n, w = zero + one, np.array([1.0, 0.0])
    a = np.column_stack([s, np.ones(_BINS)])
    target = one + n / (n.sum() + 2)  # a little towards the middle, so that parted classes end
    whole = n * (1 + 2 / (n.sum() + 2))
    for _ in range(60):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a.T * (whole * p * (1 - p))) @ a + 1e-6 * np.eye(2), a.T @ (target - whole * p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(_sigmoid(a @ w), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(one @ np.log(p) + zero @ np.log(1 - p)) / max(1.0, n.sum()))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | float:
    """The discriminant of all labelled rows that may be learned from; the share of label 1 (or 0.5) if a class is missing.

    ``stats`` is what ``features`` gives. Null labels and labels other than 0 and 1 are left out; an
    id with several labels or texts counts each pair.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("long").alias("label")).filter("label IN (0, 1)")
    rows = persisted(stats.filter("learn").join(known, "doc_id").select("part", "label", "x"), "labelled")
    d = len(STATISTICS) + 1
    sums = np.zeros((2 * PARTS, d, d))
    parts = rows.mapInArrow(_moments, "key int, i int, m array<double>")
    added = parts.select("key", "i", F.posexplode("m").alias("j", "s")).groupBy("key", "i", "j").agg(F.sum("s").alias("s"))
    for r in added.collect():  # 2 * PARTS * (statistics + 1)^2 at most
        sums[r["key"], r["i"], r["j"]] = r["s"]
    sums = sums.reshape(2, PARTS, d, d)
    n = sums[:, :, -1, -1].sum(axis=1)
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    grid = [(a, b) for a in TO_POOLED for b in TO_SPHERE]
    models = {}
    for own in range(PARTS):
        rest = sums.sum(axis=1) - sums[:, own]
        if rest[:, -1, -1].min() < 2:
            rest = sums.sum(axis=1)  # too few labels to leave a part out
        for which, (a, b) in enumerate(grid):
            models[which, own] = fitted(rest, a, b)
    counts = np.zeros((len(grid), 2 * _BINS), np.int64)
    for r in rows.mapInArrow(_binned(models), "which int, cell int, n long").groupBy("which", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["which"], r["cell"]] = r["n"]
    curves = [_curve(c) for c in counts]
    best = min(range(len(grid)), key=lambda i: curves[i][2])
    model = fitted(sums.sum(axis=1), *grid[best])
    model.slope, model.shift = curves[best][:2]
    return model


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch)))})

    return run


def score(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id, score: how likely label 1 is, for every row of ``features``.

    Null and empty texts have the statistics of an empty text and get its score; repeated rows get
    equal scores; an empty table gives an empty result. Without both labels all rows get the share of
    label 1.
    """
    if isinstance(model, float):
        return stats.select("doc_id", F.lit(model).alias("score"))
    kinds = StructType().add("doc_id", stats.schema["doc_id"].dataType).add("score", "double")
    return stats.select("doc_id", "x").mapInArrow(_scored(model), kinds)
