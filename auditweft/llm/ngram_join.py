"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when |A & B| / |A | B| >= num/den over their sets of distinct k-word shingles.
The result is exact and names, per document, the component of its links.

1. Documents with the same set form a class; only classes are compared.
2. Under any fixed order of shingles, two linked sets share at least l shingles among the first
   ``n - ceil(n * num / den) + l`` of each (multi-match prefix). The first pass takes the order of
   the fingerprints and l = 1 + n/20. A class with fewer than l prefix shingles that occur in any
   other class has no partner and is done; most text ends here after one small shuffle.
3. For the rest, shingles are ordered by document frequency, rare ones first. Each class then gets
   its own l: the dearer the candidates of its shortest prefix are estimated to be, the longer its
   prefix and the more shared prefix shingles a candidate needs (the lesser l of the two classes).
4. Groups of near copies are contracted before pairs are formed: every class is verified against
   one leading class of the shingles it shares, and joins its component. Pairs are then formed only
   between classes of different components, at the first prefix shingle they share and only if
   enough prefix shingles are shared (what lies behind the prefixes bounds the rest), and verified
   on whole sets. A link inside a component can't change it, so none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import measured, persisted, slices
from .textnum import mix, raw_bytes, shingle_sets, word_bounds, word_hashes

#: Most rows of ids and fingerprints sent to every executor at once (40 bytes each); above it the join is a shuffle.
BROADCAST_IDS = 1_000_000


def _sets(batch_texts: pa.Array, k: int):
    for a, b in slices(batch_texts):
        data, bounds = raw_bytes(batch_texts.slice(a, b - a))
        starts, ends, rows = word_bounds(data, bounds)
        yield a, shingle_sets(word_hashes(data, starts, ends), rows, b - a, k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """Sizes and two fingerprints of sets."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    two = np.array([mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return [pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(one), pa.array(two)]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Per document: set size, two set fingerprints, and its multi-match prefix in fingerprint order."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, sets in _sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                keep = n - (n * num + den - 1) // den + 1 + n // 20
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(sets)), *_marks(sets), _lists([s[:c] for s, c in zip(sets, keep)])], names=["id", "n", "sig_a", "sig_b", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n long, sig_a long, sig_b long, prefix array<long>"
    )


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """Set size, the two set fingerprints and the whole set of every text."""

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([*_marks(sets), _lists(sets)], names=["n", "sig_a", "sig_b", "toks"])

    return texts.mapInArrow(run, "n long, sig_a long, sig_b long, toks array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the least node reachable.

    Alternates large-star and small-star steps; each reduces edges by keyed minima and joins, so
    no neighbourhood is gathered in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(low, "u")
        if large:
            return moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()

    mark = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, seen = measured(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges", **mark)
    before = None
    while seen["n"] and seen != before:  # ends when a round changes nothing
        before = seen
        now, seen = measured(star(star(now, True), False), "edges", **mark)
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _close(nx: Column, ny: Column, common: Column, num: int, den: int) -> Column:
    return common * F.lit(den) >= (nx + ny - common) * F.lit(num)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id reachable by links, own id included), links.

    ``links`` counts the verified links of the row's class that the join had to look at; inside a
    component that was already joined further links aren't counted. Null and empty texts have no
    shingles, link with nothing and are their own component. Repeated rows each get a row; rows that
    share an id but not a text are compared by their own texts. A null id keeps its row, with the least
    id of those it is linked with. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    mark = ["sig_a", "sig_b", "n"]
    sig = persisted(signatures(docs, id_col, text_col, k, num, den), "sig")
    classes = persisted(sig.filter("n > 0").groupBy(*mark).agg(F.min("id").alias("rid"), F.first("prefix").alias("prefix")), "classes")
    members = sig.select("id", *mark)
    # a class goes by its least id; where that is null or names another class too, by a fingerprint
    size = {"n": F.count(F.lit(1))}
    clash, seen = measured(classes.groupBy("rid").agg(F.count("*").alias("c"), F.min(F.struct(*mark)).alias("owner")).filter("c > 1 or rid is null").drop("c"), "clashes", **size)
    clashes = seen["n"]
    if clashes:
        own = F.col("rid").isNotNull() & (F.col("owner").isNull() | (F.col("owner") == F.struct(*mark)))
        few = F.broadcast(clash) if clashes <= BROADCAST_IDS else clash
        named = classes.join(few.withColumnRenamed("rid", "_rid"), F.col("rid").eqNullSafe(F.col("_rid")), "left").withColumn("rep", F.when(own, F.col("rid")).otherwise(F.xxhash64(*mark)))
        classes = persisted(named.drop("owner", "_rid"), "classes")
    else:
        classes = classes.withColumn("rep", F.col("rid"))

    posts = classes.select("rep", "rid", *mark, F.explode("prefix").alias("tok"))
    shared = posts.groupBy("tok").count().filter("count > 1").select("tok")
    alive, seen = measured(
        posts.join(shared, "tok").groupBy("rep", "rid", *mark).count().filter(F.col("count") >= 1 + F.floor(F.col("n") / 20)).drop("count"), "alive", **size
    )
    n_alive = seen["n"]
    ids = F.broadcast(alive) if n_alive <= BROADCAST_IDS else alive
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(ids.select("rid"), F.col("_id").eqNullSafe(F.col("rid")), "left_semi").select("text")
    sets = persisted(_full_sets(texts, k).dropDuplicates(mark).join(ids.select(*mark, F.col("rep").alias("id")), mark).select("id", "toks"), "sets")

    all_toks = sets.select("id", F.size("toks").cast("long").alias("n"), F.explode("toks").alias("tok"))
    df = all_toks.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    known = all_toks.join(df, "tok")
    order = Window.partitionBy("id").orderBy("df", "tok")
    ranked = known.select("id", "n", "tok", "df", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("id")).alias("m"))
    # u = n - m shingles occur nowhere else: they come first in the order and match nothing
    base = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("long")
    ranked = ranked.withColumn("base", base - (F.col("n") - F.col("m")))
    ranked = ranked.withColumn("cost", F.sum(F.when(F.col("i") <= F.col("base") + 1, F.col("df") - 1).otherwise(0)).over(Window.partitionBy("id")))
    ranked = ranked.withColumn("ell", 1 + F.least(F.floor(F.col("n") / 10), F.floor(2 * F.log2(1 + F.col("cost") / F.lit(16)))))
    posts = persisted(
        ranked.filter(F.col("i") <= F.col("base") + F.col("ell")).filter(F.col("base") + F.col("ell") >= F.col("ell")).select("id", "n", "m", "tok", "i", "ell"), "posts"
    )

    comp = sets.select("id", F.col("id").alias("comp"))
    edges = None
    for turn in range(6):
        now = posts.join(comp, "id")
        lead_by = F.struct((F.col("n") - F.col("m")) if turn == 0 else F.xxhash64("id", F.lit(turn)), "id", "comp", "n", "m")
        lead = now.groupBy("tok").agg(F.min(lead_by).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("tok", "lead")
        tries = (
            now.join(lead, "tok")
            .filter((F.col("comp") != F.col("lead.comp")) & _bound(F.col("n"), F.col("m"), F.col("lead.n"), F.col("lead.m"), num, den))
            .groupBy("id", F.col("lead.id").alias("to"))
            .agg(F.count("*").alias("c"))
            .groupBy("id")
            .agg(F.max_by("to", F.struct("c", "to")).alias("to"))
        )
        found, seen = measured(_verify(tries.select(F.col("id").alias("a"), F.col("to").alias("b")), sets, num, den), "links", **size)
        if not seen["n"]:
            break
        edges = found if edges is None else edges.union(found)
        comp = persisted(_relabelled(comp, found), "comp")
        if seen["n"] * 50 < n_alive:
            break

    left = posts.join(comp, "id")
    mixed = left.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("tok")
    heads = posts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "tok"))).alias("head")).select("id", F.col("head.tok").alias("head"))
    left = left.join(mixed, "tok").join(heads, "id")
    x, y = left.alias("x"), left.alias("y")
    i, j = F.col("x.i"), F.col("y.i")
    at_most = F.least(i, j) + F.least(F.col("x.m") - i, F.col("y.m") - j)
    rest = F.greatest(F.col("x.m") - F.size("x.head"), F.col("y.m") - F.size("y.head"))
    pairs = x.join(
        y,
        (F.col("x.tok") == F.col("y.tok"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.comp") != F.col("y.comp"))
        & _bound(F.col("x.n"), F.col("x.m"), F.col("y.n"), F.col("y.m"), num, den)
        & _close(F.col("x.n"), F.col("y.n"), at_most, num, den)
        & F.exists(
            F.array(F.array_intersect("x.head", "y.head")),  # evaluated once
            lambda both: (F.size(both) >= F.least("x.ell", "y.ell"))
            & _close(F.col("x.n"), F.col("y.n"), F.size(both) + rest, num, den)
            & (F.element_at(both, 1) == F.col("x.tok")),
        ),
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    found = persisted(_verify(pairs.select("a", "b"), sets, num, den), "links")
    edges = found if edges is None else edges.union(found)
    comp = _relabelled(comp, found)
    counts = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    linked = comp.filter("comp != id")
    if clashes:  # the least real id of a component
        real = classes.select("rep", "rid").join(comp, F.col("rep") == F.col("id")).groupBy("comp").agg(F.min("rid").alias("least"))
        linked = comp.join(real, "comp").select("id", F.col("least").alias("comp"))
    reps = persisted(classes.select(*mark, "rep", "rid").join(linked, F.col("rep") == F.col("id"), "left").drop("id").join(counts, F.col("rep") == F.col("id"), "left").drop("id"), "reps")
    return (
        members.join(reps, mark, "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("comp", "rid", "id").alias("component_id"),
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        )
    )


def _bound(nx: Column, mx: Column, ny: Column, my: Column, num: int, den: int) -> Column:
    """Whether the shingles that occur elsewhere (m of n) leave room for a link."""
    return _close(nx, ny, F.least(mx, my), num, den)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("toks").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(_close(F.size("ta"), F.size("tb"), common, num, den)).select("a", "b")


def _relabelled(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) after further links: only the graph of the components that these join is searched."""
    of = lambda end, label: comp.select(F.col("id").alias(end), F.col("comp").alias(label))
    joined = links.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return comp.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
