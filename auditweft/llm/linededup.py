"""Line dedup with a log-template tree.

Every line is parsed at fixed depth: by its number of tokens, then by its leading tokens, with
tokens that hold a digit read as variable fields. Lines that end in one leaf and agree in most
places share a template whose differing places are variable as well. A template that occurs in
enough documents is recurring; its lines are dropped everywhere but at the first place.

Lines travel as fingerprints. Equal lines are counted before any shuffle by leaf, and only leaves
whose lines occur in enough documents are parsed further. A leaf with too many different lines is
parsed in parts; the parts' templates are then parsed like lines, in rounds, until one part holds all
templates of the leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, persisted, slices
from .textnum import mix, raw_bytes, word_bounds, word_hashes

#: Leading tokens that make a leaf.
DEPTH = 3
#: Most different lines of a leaf parsed at once while parsing in parts still unites some, and most
#: rows sent to every executor at once.
LEAF_LINES = 2000
BROADCAST_ROWS = 500_000
#: Least share of a template's places that stay constant.
CONSTANT = 0.6

_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_FIELD = np.uint64(0xF1E1D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lines(col: pa.Array, least: int):
    """Per slice of a text column: token hashes with variable fields masked, and the lines they form.

    Yields the first row, the tokens, and per line of at least ``least`` tokens its row, its place
    among the text's lines, its first token and its number of tokens.
    """
    for a, b in slices(col):
        data, bounds = raw_bytes(col.slice(a, b - a))
        starts, ends, rows = word_bounds(data, bounds)
        if not len(starts):
            continue
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        tokens = np.where(digits[ends] > digits[starts], _FIELD, word_hashes(data, starts, ends, lower=False))
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[starts]
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])]))
        count = np.diff(np.concatenate([first, [len(tokens)]]))
        keep = count >= least
        first, count = first[keep], count[keep]
        yield a, tokens, rows[first], line[first] - breaks[bounds[rows[first]]], first, count


def _prefix_hashes(tokens: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int | None) -> np.ndarray:
    """Fingerprint of each line's number of tokens and leading ``depth`` tokens (None: all)."""
    place = np.arange(len(tokens), dtype=np.uint64)
    if not len(first):
        return np.zeros(0, np.int64)
    take = count if depth is None else np.minimum(count, depth)
    start_of = np.zeros(len(tokens), np.uint64)
    start_of[first] = place[first]
    offsets = place - np.maximum.accumulate(start_of)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + offsets * _STEP), dtype=np.uint64)])
    return mix(sums[first + take] - sums[first] + mix(count.astype(np.uint64))).view(np.int64)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, fp (of the text), line, key (of the masked line), leaf hash; one row per line."""
    names = ["doc_id", "fp", "line", "n", "key", "leaf"]

    def run(batches):
        for batch in batches:
            for a, tokens, rows, line, first, count in _lines(batch.column(2), least):
                at = pa.array(a + rows)
                hashes = [_prefix_hashes(tokens, first, count, d) for d in (None, DEPTH)]
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line.astype(np.int64)), pa.array(count.astype(np.int64)), *map(pa.array, hashes)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "fp", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _line_tokens(docs: DataFrame, least: int) -> DataFrame:
    """key and token sequence (two bytes a token) of every line."""

    def run(batches):
        for batch in batches:
            for _, tokens, _, _, first, count in _lines(batch.column(2), least):
                short = (tokens >> np.uint64(48)).astype("<u2")
                key = _prefix_hashes(tokens, first, count, None)
                seqs = [short[f : f + c].tobytes() for f, c in zip(first, count)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seqs, pa.binary())], names=["key", "seq"])

    return docs.select("doc_id", "fp", "text").mapInArrow(run, "key long, seq binary")


def _parse_leaf(similar: float):
    def run(table: pa.Table) -> pa.Table:
        """Unites the table's templates; a line is a template all of whose places are constant."""
        df, keys = table.column("df").to_numpy(), table.column("key").to_numpy()
        seqs = [np.frombuffer(v, "<u2") for v in table.column("seq").to_pylist()]
        masks = [np.frombuffer(v, bool) if v is not None else np.ones(len(q), bool) for v, q in zip(table.column("fixed").to_pylist(), seqs)]
        template, weight, last = keys.copy(), df.copy(), [q.tobytes() for q in masks]
        order = np.lexsort((keys, -df, [len(q) for q in seqs]))
        made: list[int] = []
        shape = fixed = np.zeros((0, 0), np.uint16)
        for i in order:
            seq, mask = seqs[i], masks[i]
            if shape.shape[1] != len(seq):
                made, shape, fixed = [], np.zeros((64, len(seq)), np.uint16), np.zeros((64, len(seq)), bool)
            m = len(made)
            if m:
                both = fixed[:m] & mask
                same = ((shape[:m] == seq) & both).sum(1)
                same[same < np.maximum(similar * both.sum(1), CONSTANT * len(seq))] = 0
                best = int(same.argmax())
                if same[best]:
                    fixed[best] &= (shape[best] == seq) & mask
                    template[i] = keys[made[best]]
                    weight[made[best]] += df[i]
                    last[made[best]] = fixed[best].tobytes()
                    continue
            if m == len(shape):
                shape, fixed = np.concatenate([shape, np.zeros_like(shape)]), np.concatenate([fixed, np.zeros_like(fixed)])
            shape[m], fixed[m] = seq, mask
            made.append(int(i))
        return pa.table([table.column("leaf"), pa.array(keys), pa.array(template), pa.array(weight), table.column("seq"), pa.array(last, pa.binary())], names=["leaf", "key", "template", "df", "seq", "fixed"])

    return run


def _templates(rows: DataFrame, similar: float) -> DataFrame:
    """key and template of lines (leaf, key, df, seq, fixed), leaf by leaf."""
    schema = "leaf long, key long, template long, df long, seq binary, fixed binary"
    found, before = None, None
    while True:
        sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_LINES).alias("parts"))
        crowded = persisted(sizes.filter("parts > 1"), "crowded")
        left = crowded.agg(F.sum("parts").alias("n")).first()["n"]
        # parts that unite next to nothing would go on for ever: then a leaf is parsed whole
        split = left is not None and (before is None or left < 0.9 * before)
        before = left
        if split:
            now = rows.join(crowded, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))).drop("parts")
        else:
            now = rows.withColumn("part", F.lit(0))
        done = persisted(now.groupBy("leaf", "part").applyInArrow(_parse_leaf(similar), schema), "parsed")
        step = done.select("key", "template")
        if found is None:
            found = step
        else:
            up = step.select(F.col("key").alias("template"), F.col("template").alias("up"))
            found = persisted(found.join(up, "template", "left").select("key", F.coalesce("up", "template").alias("template")), "templates")
        if not split:
            return found
        rows = done.filter("key = template").join(crowded.select("leaf"), "leaf", "left_semi").select("leaf", "key", "df", "seq", "fixed")


def recurring_lines(docs: DataFrame, least: int = 5, min_docs: int = 3, similar: float = 0.8, generalise: int = 12) -> tuple[DataFrame, DataFrame]:
    """(lines to drop, line counts) of documents with columns doc_id, fp, text."""
    lines = persisted(line_keys(docs, least), "lines")
    per_doc = lines.groupBy("key", "doc_id", "fp").agg(F.min("line").alias("line"), F.first("n").alias("n"), F.first("leaf").alias("leaf"))
    keys = persisted(
        per_doc.groupBy("key").agg(
            F.count("*").alias("df"), F.min(F.struct("doc_id", "fp", "line")).alias("at"), F.first("n").alias("n"), F.first("leaf").alias("leaf")
        ),
        "keys",
    )
    long = keys.filter(F.col("n") >= generalise)
    sizes = long.groupBy("leaf").agg(F.count("*").alias("different"), F.sum("df").alias("docs"))
    sizes = sizes.filter((F.col("different") > 1) & (F.col("docs") >= min_docs))
    chosen = persisted(long.join(sizes, "leaf").select("key", "df", "leaf"), "chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    seqs = _line_tokens(docs, least).join(few, "key").groupBy("key", "leaf", "df").agg(F.max("seq").alias("seq"))
    parsed = _templates(persisted(seqs.withColumn("fixed", F.lit(None).cast("binary")), "seqs"), similar)

    named = keys.select("key", "df", "at").join(parsed, "key", "left").withColumn("template", F.coalesce("template", "key"))
    # a document that holds several lines of a template counts once
    single = named.groupBy("template").agg(F.sum("df").alias("df"), F.min("at").alias("at"), F.count("*").alias("lines")).filter(F.col("df") >= min_docs)
    united = persisted(named.select("key", "template").join(single.filter("lines > 1").select("template"), "template"), "united")
    few = F.broadcast(united) if united.count() <= BROADCAST_ROWS else united
    docs_of = lines.select("key", "doc_id", "fp").join(few, "key").groupBy("template", "doc_id", "fp").agg(F.lit(1).alias("one"))
    counted = docs_of.groupBy("template").agg(F.count("*").alias("docs"))
    recurring = single.join(counted, "template", "left").filter(F.coalesce("docs", "df") >= min_docs).select("template", "at")
    gone = persisted(named.select("key", "template").join(recurring, "template").select("key", "at"), "gone")
    drop = lines.select("doc_id", "fp", "line", "key").join(gone, "key")
    return drop.filter(~F.struct("doc_id", "fp", "line").eqNullSafe(F.col("at"))).select("doc_id", "fp", "line"), gone


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 5,
    min_docs: int = 3,
    similar: float = 0.8,
    generalise: int = 12,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and the counts n_lines, n_dropped.

    A line is what newlines part; its tokens are what white space parts. Lines under ``least``
    tokens stay. A template recurs if it occurs in at least ``min_docs`` documents. Its line stays
    where it comes first (by id, then line). Lines under ``generalise`` tokens share a template only
    if they differ in tokens with digits; longer ones if at least ``similar`` of the template's constant places agree.
    Exact repetitions of a row count as one document. Null texts stay null; null ids sort first;
    a text all of whose lines go is empty. Other columns are kept as they are; where ``docs`` has a
    column of a count's name already, ValueError asks for another name (``lines_col``, ``dropped_col``).
    """
    for c in (lines_col, dropped_col):
        if free(docs, c) != c:
            raise ValueError(f"documents have a column {c}: name the counts by lines_col and dropped_col")
    fp = F.xxhash64(F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), fp.alias("fp"), F.col(text_col).cast("string").alias("text"))
    drop, _ = recurring_lines(own, least, min_docs, similar, generalise)
    per_doc = persisted(drop.groupBy("doc_id", "fp").agg(F.collect_set(F.col("line").cast("int")).alias("gone")), "drops")
    # the documents with drops grow with the corpus: a merge join at every size
    mark, doc, text_fp, gone = (free(docs, c) for c in ("_own", "_id", "_fp", "_gone"))
    few = per_doc.hint("merge").select(F.col("doc_id").alias(doc), F.col("fp").alias(text_fp), F.col("gone").alias(gone))
    out = docs.withColumn(mark, fp).join(few, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(text_fp)), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains(gone, i))
    return (
        out.withColumn(lines_col, F.coalesce(F.size(parts), F.lit(0)).cast("long"))
        .withColumn(dropped_col, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop(mark, doc, text_fp, gone)
    )
