"""Centroid clustering of integer vectors with PCA-rotated filtering, exact in every distance.

Each vector is stored once with its leading coordinates in a rotated frame and the norm of the rest.
For a vector x and a centroid c,

    |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2  <=  |x - c|^2

so a round computes small products for all pairs, takes one exact integer distance to the centroid of
the least bound, and verifies in integers only those centroids whose bound doesn't exceed it. Any
rotation gives the same clusters; the one used is that of the vectors' principal components.

A round is one pass over the stored table: each task adds up its vectors by cluster, so k rows a task
are shuffled whatever the clusters' sizes are. Centroids (k x dim integers) travel in the closure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted

#: Components beyond this magnitude count as this: every squared distance then fits in 64 bits.
BOUND = 1 << 27
_ROWS = 4096
_PAIRS = 1 << 15


def _integers(vec_col: str, scale: int) -> Column:
    scaled = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    return F.transform(F.col(f"`{vec_col}`").cast("array<double>"), scaled)


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v array<int>: vectors of exactly dim components, none null or non-finite."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter((F.size(v) == dim) & ~bad).select(F.col(f"`{id_col}`").alias("vec_id"), _integers(vec_col, scale).alias("v"))


def _lists(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    data = np.ascontiguousarray(x)
    width = data.shape[1] * data.itemsize
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(col: pa.Array, kind: type, width: int) -> np.ndarray:
    if not len(col) or not width:
        return np.zeros((len(col), width), kind)
    start = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
    return np.frombuffer(col.buffers()[2], kind, len(col) * width, start).reshape(len(col), width)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.hstack([_lists(batch.column("v"), dim), np.ones((batch.num_rows, 1), np.int64)]).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim + 1), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    return run


def principal_frame(vecs: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (columns by falling variance) over all vectors; (dim + 1)^2 sums reach the driver."""
    parts = vecs.select("v").mapInArrow(_moments(dim), "i int, sums array<double>")
    rows = parts.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dim + 1, dim + 1))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    n = max(1.0, m[dim, dim])
    mean = m[dim, :dim] / n
    _, rotation = np.linalg.eigh(m[:dim, :dim] / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(rotation[:, ::-1])


def _rotated(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    y = (x - mean) @ rotation
    return np.ascontiguousarray(y[:, :leading]), np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def _store(dim: int, mean: np.ndarray, rotation: np.ndarray, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lists(batch.column("v"), dim)
            lead, rest = _rotated(x, mean, rotation, leading)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": _packed(x.astype(np.int32)), "lead": _packed(lead), "rest": pa.array(rest)})

    return run


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, cents: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), the squared distance, and how many pairs were verified."""
    own, theirs = (lead**2).sum(axis=1) + rest**2, (c_lead**2).sum(axis=1) + c_rest**2
    size = own[:, None] + theirs[None, :]
    low = size - 2 * (lead @ c_lead.T + rest[:, None] * c_rest[None, :])
    low -= 1e-9 * size + 1e-6  # more than rounding can add
    label = low.argmin(axis=1)
    best = _exact(x, cents[label])
    rows, cols = np.nonzero(low <= best[:, None])
    for a in range(0, len(rows), _PAIRS):
        r, c = rows[a : a + _PAIRS], cols[a : a + _PAIRS]
        d = _exact(x[r], cents[c])
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        one = np.concatenate([[True], r[1:] != r[:-1]])
        r, c, d = r[one], c[one], d[one]
        better = (d < best[r]) | ((d == best[r]) & (c < label[r]))
        label[r[better]], best[r[better]] = c[better], d[better]
    return label, best, len(rows)


class _Round:
    """Centroids of one round with their rotated coordinates."""

    def __init__(self, cents: np.ndarray, mean: np.ndarray, rotation: np.ndarray, leading: int):
        self.cents, self.leading = cents, leading
        self.lead, self.rest = _rotated(cents, mean, rotation, leading)

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        dim = self.cents.shape[1]
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            x = _unpacked(part.column("v"), np.int32, dim).astype(np.int64)
            lead, rest = _unpacked(part.column("lead"), np.float64, self.leading), part.column("rest").to_numpy(zero_copy_only=False)
            yield a, x, *nearest(x, lead, rest, self.cents, self.lead, self.rest)


def _sums(step: _Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = step.cents.shape
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, label, _, _ in step.of(batch):
                np.add.at(total, label, x)
                count += np.bincount(label, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]), "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})

    return run


def _labels(step: _Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, label, best, verified in step.of(batch):
                ids = batch.column("vec_id").slice(a, len(label))
                share = pa.array(np.full(len(label), verified / max(1, len(label))))
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(label.astype(np.int32)), "distance": pa.array(best), "verified": share})

    return run


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
    leading: int = 16,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, verified: one row per kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x counts as
    floor(scale * x), at most 2^27 in magnitude. Centroids start as the k vectors with the least
    SHA-256 of ``seed:vec_id``; each round assigns every vector to the nearest centroid (ties: smaller
    number) and moves non-empty centroids to the componentwise floor of the mean. ``verified`` is the
    mean number of centroids a vector of its batch was compared with in integers in the last pass.

    A null id hashes like an empty one; rows that share an id are vectors of their own and start in
    order of their components. With fewer than k vectors there are as many centroids as vectors; an
    empty table gives an empty result. Columns other than id and vector are not carried.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    out = T.StructType().add("vec_id", id_type)
    vecs = kept_vectors(vectors, id_col, vec_col, dim, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vecs.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    cents = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    leading = min(leading, dim)
    mean, rotation = principal_frame(vecs, dim)
    kinds = T.StructType().add("vec_id", id_type).add("v", "binary").add("lead", "binary").add("rest", "double")
    stored = persisted(vecs.mapInArrow(_store(dim, mean, rotation, leading), kinds), "rotated")
    for _ in range(rounds if len(cents) else 0):
        step = _Round(cents, mean, rotation, leading)
        parts = stored.select("v", "lead", "rest").mapInArrow(_sums(step), "cluster int, n long, sums array<long>")
        moved = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        cents = cents.copy()
        for r in moved:  # at most k * dim rows
            cents[r["cluster"], r["j"]] = r["s"] // r["n"]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents.tolist()]
    out = out.add("cluster", "integer").add("distance", "long").add("verified", "double")
    if not names:
        empty = stored.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("verified"))
        labelled = empty.filter(F.lit(False))
    else:
        labelled = persisted(stored.mapInArrow(_labels(_Round(cents, mean, rotation, leading)), out), "labelled")
    # One row a centroid: at most k.
    sums = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum"))
    total = sums.agg(F.sum("_sum").alias("_all"))
    shas = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    per = sums.join(F.broadcast(shas), "cluster").crossJoin(total)  # the total is one row
    per = per.select("cluster", F.col("_sum").cast("long").alias("cluster_inertia"), F.col("_all").cast("long").alias("inertia"), "centroid_sha256")
    return labelled.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "verified")
