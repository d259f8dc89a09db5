"""Benchmark decontamination by latent semantic retrieval and sequence checks.

1. Texts are cut into overlapping passages. TF-IDF vectors are taken over the words of the benchmark
   items (other words can't raise a cosine with an item); document frequencies count all passages.
   Texts are read once: their item words' numbers are stored and read by the later passes.
2. A randomised, single-pass singular value decomposition of the passage matrix A: every task adds up
   its part of A'A times a random matrix, parts are summed by blocks of rows, and the Nystroem
   formula gives the leading right singular vectors. An item's latent space is the span of these
   vectors and its own row: it doesn't leave the space, however large the corpus, a latent cosine is
   never below the cosine of the full vectors, and other items have no part in it.
3. Passages whose latent cosine with an item passes a low threshold are candidates. The longest
   common subsequence of words confirms copies; looser ones (paraphrases) also need the item's
   answer, its last words, to be there. Cosines are taken only where the words around a passage can
   hold a subsequence that long: of an item's rarest words a certain number must be there.
4. Longer items are searched for in segments that fit a passage; an item's segments are joined where
   they follow one another along the text, and their words count together.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, persisted, slices
from .textnum import raw_bytes, word_bounds
from .words import WordTable, letters_only

PASSAGE, STRIDE = 48, 24
#: Most words of an item's segment.
SEGMENT = 64
#: Items searched for in one pass over the stored word numbers; results don't depend on it.
ITEMS = 2000
#: Most characters of all items; they are held on the driver and sent to every task.
ITEM_CHARS = 256 << 20
#: Most words of the singular vectors: the most frequent ones in use. Others have axes of their own.
LATENT_WORDS = 1 << 16


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def segments(items: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """(number of the item, words) of the items' equal segments, in order."""
    out = []
    for k, (_, words) in enumerate(items):
        n = ceil(len(words) / SEGMENT)
        out += [(k, words[len(words) * j // n : len(words) * (j + 1) // n]) for j in range(n)]
    return out


def longest_chain(hits: list[tuple[int, int, int]]) -> int:
    """Most words of hits (segment, place, words) of rising segments at places that don't fall."""
    places: list[int] = []
    best: list[int] = []  # rises with the place
    for _, group in groupby(sorted(hits), key=lambda h: h[0]):
        made = []
        for _, place, words in group:
            k = bisect_right(places, place)
            made.append((place, words + (best[k - 1] if k else 0)))
        for place, total in made:
            k = bisect_right(places, place)
            if k and best[k - 1] >= total:
                continue
            if k and places[k - 1] == place:
                k -= 1
                best[k] = total
            else:
                places.insert(k, place)
                best.insert(k, total)
            while k + 1 < len(best) and best[k + 1] <= total:
                del places[k + 1], best[k + 1]
    return best[-1] if best else 0


def _word_ids(table: WordTable, texts: pa.Array):
    """Per slice: first row, rows, word ids (-1: not in the vocabulary, -2: no letter dropped) per row order."""
    for a, b in slices(texts, 1 << 20):
        data, bounds = raw_bytes(texts.slice(a, b - a))
        starts, ends, rows = word_bounds(data, bounds)
        if not len(starts):
            continue
        known, at = table.index(data, starts, ends)
        ids = known[at, 0]
        keep = ids > -2
        yield a, b - a, rows[keep], ids[keep]


def _encode(vocab: dict[str, int], kind: type):
    """Documents (text, doc_id) to doc_id and the word ids of the text."""
    name = f"words {uuid.uuid4().hex}"

    def run(batches):
        table = held(name, lambda: WordTable(lambda words: np.array([[vocab.get(w, -1) if w else -2] for w in words], np.int32), 500_000))
        for batch in batches:
            for a, n_rows, rows, ids in _word_ids(table, batch.column(0)):
                ends = np.cumsum(np.bincount(rows, minlength=n_rows)) * np.dtype(kind).itemsize
                buffers = [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n_rows), pa.Array.from_buffers(pa.binary(), n_rows, buffers)], names=["doc_id", "ids"])

    return run


def _stored(col: pa.Array, kind: type):
    """What _word_ids gives, from stored ids."""
    width = np.dtype(kind).itemsize
    for a, b in slices(col):
        part = col.slice(a, b - a)
        bounds = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        if bounds[-1] > bounds[0]:
            ids = np.frombuffer(part.buffers()[2], kind, (bounds[-1] - bounds[0]) // width, bounds[0])
            yield a, b - a, np.repeat(np.arange(b - a), np.diff(bounds) // width), ids


def _passages(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the passages of texts."""
    counts = np.bincount(rows, minlength=n_rows)
    n = np.where(counts > 0, np.maximum(1, -(-(counts - PASSAGE) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(n_rows), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, np.repeat(np.cumsum(counts) - counts, n) + k * STRIDE, np.minimum(PASSAGE, counts[row] - k * STRIDE)


def _terms(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, count) of the used words of each passage."""
    hits = np.flatnonzero((ids >= 0) & use[ids])
    # a word lies in the passages that begin at most PASSAGE words before it
    lo, hi = np.searchsorted(begin + size, hits, side="right"), np.searchsorted(begin, hits, side="right")
    n = hi - lo
    passage = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    code, count = np.unique(passage * np.int64(len(use)) + np.repeat(ids[hits], n), return_counts=True)
    return code // len(use), code % len(use), count


def _frequencies(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Number of passages that hold each word."""
    hits = np.flatnonzero(ids >= 0)
    lo, hi = np.searchsorted(begin + size, hits, side="right"), np.searchsorted(begin, hits, side="right")
    order = np.argsort(ids[hits], kind="stable")
    w, lo, hi = ids[hits][order], lo[order], hi[order]
    # passages that an earlier place of the same word has counted
    done = np.zeros(len(w), np.int64)
    done[1:] = np.where(w[1:] == w[:-1], hi[:-1], 0)
    return np.bincount(w, hi - np.maximum(lo, done), words).astype(np.int64)


def _weights(terms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row-normalised TF-IDF as (passage, word, weight)."""
    p, w, c = terms
    x = (1 + np.log(c)) * idf[w]
    norm = np.sqrt(np.bincount(p, x * x, int(p.max()) + 1 if len(p) else 0))
    return p, w, (x / norm[p]).astype(np.float32) if len(p) else x.astype(np.float32)


def _blocks(p: np.ndarray, w: np.ndarray, x: np.ndarray, step: int = 1000):
    """(passages, words, dense weights) of some rows at a time: small dense products are quicker than sparse sums."""
    cut = 0
    while cut < len(p):
        end = min(len(p), cut + step)
        if end < len(p):
            end = int(np.searchsorted(p, p[end - 1], side="right"))
        own, row = np.unique(p[cut:end], return_inverse=True)
        words, column = np.unique(w[cut:end], return_inverse=True)
        block = np.zeros((len(own), len(words)), np.float32)
        block[row, column] = x[cut:end]
        yield own, words, block
        cut = end


def _times(p: np.ndarray, w: np.ndarray, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages with any term, their rows of A @ m); terms come in order of passage."""
    parts = [(own, block @ m[words]) for own, words, block in _blocks(p, w, x)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, m.shape[1]), m.dtype)
    return np.concatenate([own for own, _ in parts]), np.concatenate([rows for _, rows in parts])


def _items(bench: DataFrame, id_col: str, text_col: str) -> list[tuple[int, list[str]]]:
    own = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).dropDuplicates()
    if (own.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0) > ITEM_CHARS:
        raise ValueError(f"items of more than {ITEM_CHARS} characters: pass them in several calls")
    rows = own.orderBy("i", "t").collect()
    out = [(r["i"], [w for w in letters_only([x.encode() for x in (r["t"] or "").split()]) if w]) for r in rows]
    return [(i, w) for i, w in out if i is not None and w]


def vocabulary(items: list[tuple[int, list[str]]]) -> dict[str, int]:
    vocab: dict[str, int] = {}
    for _, words in items:
        for w in words:
            vocab.setdefault(w, len(vocab))
    return vocab


def latent_space(docs: DataFrame, kind: type, items: list[tuple[int, list[str]]], vocab: dict[str, int], rank: int = 192, common: float = 0.05, own_words: int = 8, seed: int = 1):
    """(document frequencies, idf, each word's row of the vectors or -1, ``rank`` leading right singular vectors of the passages).

    ``docs`` has stored word ids in its column ids. idf is 0 for words in more than ``common`` of all
    passages, except the ``own_words`` rarest of every item: an item that is copied everywhere keeps
    words to be found by.
    """
    size = len(vocab)

    def count(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, n_rows, rows, ids in _stored(batch.column(0), kind):
                row, begin, length = _passages(rows, n_rows)
                n += len(row)
                df += _frequencies(ids, begin, length, size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["w", "n"])

    counts = {r["w"]: r["n"] for r in docs.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = max(1, counts.get(-1, 0))
    df = np.array([counts.get(i, 0) for i in range(size)])
    # on few passages a common word can't be told from a copied one: words of 50 passages always count
    use = df <= max(50, common * total)
    for _, words in items:
        ids = np.array(sorted({vocab[w] for w in words}))
        use[ids[np.argsort(df[ids], kind="stable")[:own_words]]] = True
    idf = np.where(use, np.log((total + 1) / (df + 1)) + 1, 0.0)
    top = np.flatnonzero(use)
    top = np.sort(top[np.argsort(-df[top], kind="stable")][:LATENT_WORDS])
    column = np.full(size, -1)
    column[top] = np.arange(len(top))
    rank = min(rank, len(top))
    omega = np.random.default_rng(seed).normal(size=(len(top), min(len(top), rank + 16))).astype(np.float32)
    block = 512

    def sketch(batches):
        y = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for _, n_rows, rows, ids in _stored(batch.column(0), kind):
                _, begin, length = _passages(rows, n_rows)
                _add_gram(y, *_axes(*_weights(_terms(ids, begin, length, use), idf), column), omega)
        for b in range(0, len(omega), block):
            if y[b : b + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([y[b : b + block].astype(np.float32).tobytes()], pa.binary())], names=["b", "y"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, np.float32) for v in table.column("y").to_pylist()]
        total = np.sum(parts, axis=0, dtype=np.float64).astype(np.float32)
        return pa.table([table.column("b").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["b", "y"])

    # summed in groups of parts first: no task takes the parts of all others
    parts = docs.mapInArrow(sketch, "b long, y binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))
    sums = parts.groupBy("b", "g").applyInArrow(add, "b long, y binary").groupBy("b").applyInArrow(add, "b long, y binary")
    y = np.zeros(omega.shape, np.float64)
    for r in sums.collect():
        y[r["b"] : r["b"] + block] = np.frombuffer(r["y"], np.float32).reshape(-1, omega.shape[1])
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * omega
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-12)))
    u, _, _ = np.linalg.svd(y @ half, full_matrices=False)
    return df, idf, column, np.ascontiguousarray(u[:, :rank].astype(np.float32))


def _axes(p: np.ndarray, w: np.ndarray, x: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms whose words have a row of the singular vectors, by that row."""
    keep = column[w] >= 0
    return p[keep], column[w[keep]], x[keep]


def _projected(n: int, p: np.ndarray, w: np.ndarray, x: np.ndarray, column: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of n rows along the singular vectors."""
    out = np.zeros((n, basis.shape[1]))
    own, rows = _times(*_axes(p, w, x, column), basis)
    out[own] = rows
    return out


def latent_cosines(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of passages and items, pair by pair, in the span of the singular vectors and the item.

    ``dots`` are those of the unit vectors, ``a`` and ``b`` the coordinates along the singular vectors.
    """
    rest = 1 - (b * b).sum(1)  # of the item's squared length, outside of the singular vectors
    along = (dots - (a * b).sum(1)) ** 2 / np.maximum(rest, 1e-6)
    norm = np.sqrt((a * a).sum(1) + np.where(rest > 1e-6, along, 0.0))
    return np.minimum(dots / np.maximum(norm, 1e-9), 1.0)


def _add_gram(y: np.ndarray, p: np.ndarray, w: np.ndarray, x: np.ndarray, omega: np.ndarray) -> None:
    """y += A'(A omega)."""
    for _, words, block in _blocks(p, w, x):
        y[words] += block.T @ (block @ omega[words])


def item_matrix(items, vocab, idf):
    rows = np.repeat(np.arange(len(items)), [len(w) for _, w in items])
    ids = np.array([vocab[x] for _, w in items for x in w])
    code, count = np.unique(rows * np.int64(len(vocab)) + ids, return_counts=True)
    p, w = code // len(vocab), code % len(vocab)
    keep = idf[w] > 0
    return _weights((p[keep], w[keep], count[keep]), idf)


def find(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cosine: float = 0.3,
    copied: float = 0.7,
    loose: float = 0.5,
    answer_words: int = 6,
    answer_share: float = 0.6,
    rank: int = 192,
) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, cosine, lcs (share of the item's words).

    Words are lower-case letter runs parted by white space. An item is found in a document if, within
    a candidate passage and a stride around it, its longest common subsequence holds ``copied`` of
    its words, or ``loose`` of them and ``answer_share`` of its last ``answer_words`` words. Of an item
    of over 64 words each of its equal segments is searched for in this way; those of which ``loose``
    is there count, in order along the text, for the item's share. Null and empty texts and items match
    nothing; repeated rows give one row; rows with null ids are left out, other columns are ignored.
    All items share one vocabulary and one space; more than ``ITEM_CHARS`` characters of items are refused.
    """
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    every = _items(bench, item_col, item_text_col)
    schema = "doc_id long, item_id long, cosine double, lcs double"
    out = docs.sparkSession.createDataFrame([], schema)
    if every:
        vocab = vocabulary(every)
        kind = np.int16 if len(vocab) < 1 << 15 else np.int32
        words = persisted(own.mapInArrow(_encode(vocab, kind), "doc_id long, ids binary"), "words")
        space = latent_space(words.select("ids"), kind, every, vocab, rank)
        for lo in range(0, len(every), ITEMS):
            out = out.union(words.select("ids", "doc_id").mapInArrow(_searcher(every[lo : lo + ITEMS], vocab, kind, *space, cosine, copied, loose, answer_words, answer_share), schema))
    return out.filter("doc_id is not null").groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def _postings(owner: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first posting of each word and the end, order of the postings, owners in this order)."""
    order = np.argsort(words, kind="stable")
    return np.append(0, np.cumsum(np.bincount(words, minlength=size))), order, owner[order]


def _expand(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, posting) of every posting of every word."""
    n = first[words + 1] - first[words]
    at = np.repeat(np.arange(len(words)), n)
    return at, np.repeat(first[words], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def rare_words(seqs: list[list[int]], df: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, word) of each item's rarest words, and how many of them each item's copies hold.

    A common subsequence of ``need`` words leaves out n - need of the item's n words, so that of its
    n - need + t rarest ones at least t are there.
    """
    owner, words, hold = [], [], []
    for k, seq in enumerate(seqs):
        n = len(seq)
        need = next((m for m in range(1, n) if m / n >= least), n)
        hold.append(1 + need // 3)
        rare = np.array(seq)[np.argsort(df[seq], kind="stable")][: n - need + hold[-1]]
        words.append(np.unique(rare))
        owner.append(np.full(len(words[-1]), k))
    return np.concatenate(owner), np.concatenate(words), np.array(hold)


def _searcher(items, vocab, kind, df, idf, column, basis, cosine, copied, loose, answer_words, answer_share):
    use = idf > 0
    parts = segments(items)
    p, w, x = item_matrix(parts, vocab, idf)
    item_at = _projected(len(parts), p, w, x, column, basis)
    first, order, item_of = _postings(p, w, len(vocab))
    weight_of = x[order]
    seqs = [[vocab[t] for t in words] for _, words in parts]
    answers = [[vocab[t] for t in words[-answer_words:]] for _, words in items]
    last_of = {k: j for j, (k, _) in enumerate(parts)}  # an item's last segment
    owner, words, hold = rare_words(seqs, df, min(copied, loose))
    rare_first, _, rare_item = _postings(owner, words, len(vocab))
    rare = np.diff(rare_first) > 0

    def confirm(ids: np.ndarray, j: int) -> tuple[int, bool]:
        """Words of the segment that are there in order (0 if too few), and whether the item's answer is."""
        near, k = ids.tolist(), parts[j][0]
        common = lcs_length(seqs[j], near)
        if common < min(copied, loose) * len(seqs[j]):
            return 0, False
        return common, last_of[k] == j and lcs_length(answers[k], near) >= answer_share * len(answers[k])

    def share_of(k: int, hits: list[tuple[int, int, int, bool]]) -> float:
        """Share of the item's words in its segments' hits (segment, place, words, answered); 0 if not found."""
        share = longest_chain([h[:3] for h in hits]) / len(items[k][1])
        return share if share >= copied or share >= loose and any(h[3] for h in hits) else 0.0

    def possible(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) where the words from ``begin`` to ``end`` hold enough of the item's rare words."""
        hits = np.flatnonzero((ids >= 0) & rare[ids])
        at, posting = _expand(ids[hits].astype(np.int64), rare_first)
        code = np.sort(rare_item[posting] * np.int64(len(ids)) + hits[at])
        item = code // max(1, len(ids))
        last = np.arange(len(code)) + hold[item] - 1
        near = np.flatnonzero(last < len(code))
        near = near[code[last[near]] - code[near] < PASSAGE + 2 * STRIDE]
        near = near[item[last[near]] == item[near]]
        a, b = code[near] % max(1, len(ids)), code[last[near]] % max(1, len(ids))
        lo, hi = np.searchsorted(end, b, side="right"), np.searchsorted(begin, a, side="right")
        n = np.maximum(hi - lo, 0)
        passage = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(passage * np.int64(len(parts)) + np.repeat(item[near], n))
        return pairs // len(parts), pairs % len(parts)

    def cosines(terms, own: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Latent cosines of pairs of passages, from ``own``, and items (0 without a used word)."""
        p, w, x = _weights(terms, idf)
        p = np.searchsorted(own, p)
        at, posting = _expand(w.astype(np.int64), first)
        dots = np.bincount(p[at] * len(parts) + item_of[posting], x[at] * weight_of[posting], len(own) * len(parts)).reshape(len(own), -1)
        return latent_cosines(dots[passage, item], _projected(len(own), p, w, x, column, basis)[passage], item_at[item])

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            docs = batch.column(1)
            for a, n_rows, rows, ids in _stored(batch.column(0), kind):
                hits: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = {}
                nearest: dict[tuple[int, int], float] = {}
                row, begin, size = _passages(rows, n_rows)
                counts = np.bincount(rows, minlength=n_rows)
                stop = np.cumsum(counts)
                # a passage and a stride around it
                start, end = np.maximum((stop - counts)[row], begin - STRIDE), np.minimum(stop[row], begin + size + STRIDE)
                q, k = possible(ids, start, end)
                for lo in range(0, len(q), 1000):
                    qs, ks = q[lo : lo + 1000], k[lo : lo + 1000]
                    own = np.unique(qs)
                    scores = cosines(_subset(ids, begin[own], size[own], own, use), own, np.searchsorted(own, qs), ks)
                    for i in np.flatnonzero(scores >= cosine):
                        j = int(ks[i])
                        common, answered = confirm(ids[start[qs[i]] : end[qs[i]]], j)
                        if common:
                            key = int(row[qs[i]]), parts[j][0]
                            hits.setdefault(key, []).append((j, int(start[qs[i]]), common, answered))
                            nearest[key] = max(nearest.get(key, 0.0), float(scores[i]))
                for (r, k), own in hits.items():
                    share = share_of(k, own)
                    if share:
                        found.append((docs[a + r].as_py(), items[k][0], nearest[r, k], share))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs"]
            )

    return run


def _subset(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, count) of the used words of the passages ``own`` only."""
    passage = np.repeat(own, size)
    words = ids[np.repeat(begin, size) + np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size)]
    keep = (words >= 0) & use[words]
    code, count = np.unique(passage[keep] * np.int64(len(use)) + words[keep], return_counts=True)
    return code // len(use), code % len(use), count
