"""Centroid clustering against a plain version with Python integers, and the filter against all distances."""

import hashlib
import math
import random

import numpy as np
from auditweft.llm.centroids import BOUND, _rotated, cluster, nearest


def plainly(rows, k, rounds, dim, scale=256, seed=2):
    def number(x):
        return math.floor(max(-BOUND, min(BOUND, x * scale)))

    kept = [(i, tuple(number(x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, got) if c == j]
            if own:
                cents[j] = tuple(sum(x) // len(own) for x in zip(*own))
    got = assign()
    inertia = {j: sum(d for d, c in got if c == j) for j in range(len(cents))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, inertia[c], sum(d for d, _ in got), name[c]) for (i, _), (d, c) in zip(kept, got)), key=repr)


def rows_of(out):
    return sorted((tuple(r) for r in out.drop("verified").collect()), key=repr)


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(300)]  # one very common vector
    rows += [(5, [9.0] * 6), (5, [9.0] * 6), (None, [0.1] * 6), (None, [0.2] * 6), (2001, [1e300] + [0.0] * 5), (2002, [-1e300] * 6)]
    rows += [(3000, None), (3001, [1.0] * 5), (3002, [1.0] * 7), (3003, [1.0] * 5 + [None]), (3004, [float("nan")] * 6), (3005, [float("inf")] + [0.0] * 5)]
    data = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    want = plainly(rows, 12, 4, 6)
    assert rows_of(cluster(data.repartition(7), k=12, rounds=4, dim=6, leading=2)) == want
    assert rows_of(cluster(data, k=12, rounds=4, dim=6, leading=6)) == want


def test_ties_few_vectors_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(i, [0.5, -0.5]) for i in range(9)]
    got = rows_of(cluster(spark.createDataFrame(same, schema), k=4, rounds=2, dim=2))
    assert got == plainly(same, 4, 2, 2) and {r[1] for r in got} == {0}
    two = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert rows_of(cluster(spark.createDataFrame(two, schema), k=40, rounds=3, dim=2)) == plainly(two, 40, 3, 2)
    none = cluster(spark.createDataFrame([], schema), dim=2)
    assert none.count() == 0 and none.columns[:4] == ["vec_id", "cluster", "distance", "cluster_inertia"]


def test_filter_never_loses_the_nearest_and_verifies_few():
    rng = np.random.default_rng(2)
    cents = rng.integers(-300, 300, (40, 64))
    cents[7] = cents[3]
    x = cents[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 64))
    x[:40] = cents
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    mean = x.mean(axis=0)
    label, best, verified = nearest(x, *_rotated(x, mean, rotation, 16), cents, *_rotated(cents, mean, rotation, 16))
    full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert verified < 0.1 * full.size
