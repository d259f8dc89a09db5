"""Exact top-k inner-product search: tiled matrix products with partial selection and tree merging.

Vectors and queries are cut into tiles of bounded size. Each pair of tiles is one keyed group: a
task multiplies the two matrices, selects the best k per query of the tile, and emits only those.
The per-query lists are then merged in a tree of bounded fan-in. Nothing is broadcast or collected,
so queries may grow with the table; the work is queries x vectors in any case.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted

#: Largest magnitude whose products can be summed exactly in doubles is checked per tile.
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vid, v array<long>, dim: components floor(scale * x); rows with null ids, nulls or non-finite values go."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
        .select(F.col(id_col).cast("long").alias("vid"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
        .withColumn("dim", F.size("v"))
    )


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score", "shard"]
        kinds = [pa.int64()] * 5
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        dim = left.column("dim")[0].as_py()
        ids = right.column("vid").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        vecs, query = _matrix(right.column("v"), dim)[by_id], _matrix(left.column("v"), dim)
        own = left.column("vid").to_numpy()
        key = left.column("query").to_numpy()
        shard = right.column("shard")[0].as_py()
        top = float(np.abs(vecs).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, dim)
        kind, none = (np.float64, -np.inf) if top < _EXACT else (np.int64, np.iinfo(np.int64).min)
        vecs, query = np.ascontiguousarray(vecs.T.astype(kind)), query.astype(kind)
        out: list[list[np.ndarray]] = [[], [], [], []]
        step = max(1, (1 << 21) // max(1, len(ids)))
        for a in range(0, len(query), step):
            scores = query[a : a + step] @ vecs
            same = own[a : a + step, None] == ids[None, :]
            scores[same] = none
            if len(ids) > k:
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                take = (scores >= least[:, None]) & ~same
            else:
                take = ~same
            q, v = np.nonzero(take)  # in order of query, then of vector id
            s = scores[q, v]
            best = np.lexsort((np.arange(len(q)), -s, q))
            q, v, s = q[best], v[best], s[best]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            keep = place < k
            q, v, s = q[keep], v[keep], s[keep]
            for to, x in zip(out, (key[a + q], own[a + q], ids[v], s.astype(np.int64))):
                to.append(x)
        cols = [np.concatenate(x) for x in out]
        return pa.table([*map(pa.array, cols), pa.array(np.full(len(cols[0]), shard, np.int64))], names=names)

    return run


def _best(k: int, *keys: Column | str) -> Column:
    lists = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    return F.slice(lists, 1, k).alias("best")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    query_rows: int = 4096,
    shard_rows: int = 8192,
    fan_in: int = 16,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products per query row.

    Queries are the rows where ``is_query`` holds; candidates are all rows with another id; ties go
    to the smaller id. Vectors that are null, or hold a null, NaN or infinite component, or have a
    null id, take no part. Only vectors of the query's length are its candidates. Repeated rows are
    candidates one by one; a query row that repeats exactly is answered once. Scores must fit in 64
    bits. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    own = persisted(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    asked = own.filter(is_query).dropDuplicates(["vid", "v"]).withColumn("query", F.xxhash64("vid", "v"))
    n, nq = own.count(), asked.count()
    shards, tiles = max(1, ceil(n / shard_rows)), max(1, ceil(nq / query_rows))
    right = own.withColumn("shard", F.pmod(F.xxhash64("vid", F.lit(7)), F.lit(shards)).cast("long")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    left = asked.withColumn("tile", F.pmod("query", F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    left = left.select(*(F.col(c).alias(c) for c in left.columns))  # columns of its own: both sides come from one table
    lists = (
        left.groupBy("tile", "shard", "dim")
        .cogroup(right.groupBy("tile", "shard", "dim"))
        .applyInArrow(_tile(k), "query long, query_id long, vec_id long, score long, shard long")
    )
    while shards > fan_in:
        shards = ceil(shards / fan_in)
        lists = (
            lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
            .groupBy("query", "query_id", "shard")
            .agg(_best(k))
            .select("query", "query_id", "shard", F.explode("best").alias("b"))
            .select("query", "query_id", F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"), "shard")
        )
    merged = lists.groupBy("query", "query_id").agg(_best(k))
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
