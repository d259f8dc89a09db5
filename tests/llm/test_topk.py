"""Exact top-k against brute force: ties, odd vectors, several tiles."""

import math
import random

from auditweft.llm.topk import top_k
from pyspark.sql import functions as F


def test_equals_brute_force_over_many_tiles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.random()]) for _ in range(6)], "x") for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, "same") for i in range(60)] + [(2000, None, "n"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (2002, [float("nan")] * 6, "n"), (2003, [float("inf")] * 6, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = top_k(df, F.col("vid") % 50 == 0, k=7, query_rows=3, shard_rows=20, fan_in=3).collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {r.query_id for r in out} == {i for i in ints if i % 50 == 0}


def test_few_rows_and_other_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    out = [tuple(r) for r in top_k(df, F.col("vid") == 0).collect()]
    assert out == [(0, 1, 1, 1024 * 1024 + 2048 * 2048)]
    assert top_k(df.limit(0), F.col("vid") == 0).count() == 0
