"""Packing tokenised documents into fixed-length sequences: first-fit decreasing in random groups.

Tokenising runs once over the texts and emits pieces (document, start, length, checksum). Full
pieces fill a sequence each; the rest are dealt out by a hash into groups, and in each group a
tournament tree of bin capacities finds the first bin a piece fits in.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, measured, slices
from .textnum import raw_bytes, word_bounds, word_hashes
from .words import Known, Rows, raw_words

#: Most different words kept in a worker's memory between batches.
CACHE_WORDS = 800_000
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True


class WordIds:
    """Token ids of words, remembered per worker by fingerprints of their bytes.

    The tokenizer's own rules never join characters across white space, nor a letter and a mark behind
    it; so a text's ids are those of its words and of the marks at their ends, in order. It lower-cases,
    so words that differ in the case of A-Z only have the same ids; words with ``<`` stay whole and
    keep their case, as the tokenizer's special strings do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(CACHE_WORDS)
        self.ids, self.spans = Rows(), Rows()

    def _learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 8192):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[a : a + 8192]], add_special_tokens=False)]
            size = np.array([len(x) for x in found], np.int64)
            self.spans.add(np.column_stack([self.ids.used + np.cumsum(size) - size, size]).astype(np.int32))
            self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))

    def _forget(self) -> None:
        self.ids.clear()
        self.spans.clear()

    def _parts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, starts, ends, rows and fingerprints of the words and the marks behind them."""
        data, bounds = raw_bytes(col)
        starts, ends, rows = word_bounds(data, bounds)
        if not len(starts):
            return data, starts, ends, rows, np.zeros(0, np.uint64)
        stem = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1] + 1
        before, last = data[np.maximum(stem - 2, 0)], data[np.maximum(stem - 1, 0)]
        # letters of one byte, or the accented ones of U+00C0 to U+00FF
        letter = _LETTER[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (stem - 2 >= starts)
        special = np.zeros(len(starts), bool)
        special[np.searchsorted(starts, np.flatnonzero(data == 60), side="right") - 1] = True
        cut = (stem > starts) & (stem < ends) & letter & ~special
        first = np.arange(len(starts)) + np.cumsum(cut) - cut
        n = len(starts) + int(cut.sum())
        begin, end, row, whole = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
        begin[first], end[first], row[first], whole[first] = starts, np.where(cut, stem, ends), rows, special
        tail = first[cut] + 1
        begin[tail], end[tail], row[tail] = stem[cut], ends[cut], rows[cut]
        h = word_hashes(data, begin, end)
        if special.any():
            h[whole] = word_hashes(data, begin[whole], end[whole], lower=False) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        return data, begin, end, row, h

    def texts(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, each with ``end_id`` behind it, number of ids of each text)."""
        data, starts, ends, rows, h = self._parts(col)
        if not len(h):
            return np.full(len(col), end_id, np.uint32), np.ones(len(col), np.int64)
        at = self.known.numbers(h, lambda new: self._learn(raw_words(data, starts[new], ends[new])), self._forget)
        begin, size = self.spans.all[at].T.astype(np.int64)
        counts = np.bincount(rows, size, len(col)).astype(np.int64) + 1
        # each word's ids stand behind those of the words and the ended texts before it
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out = np.full(int(counts.sum()), end_id, np.uint32)
        out[np.repeat(np.cumsum(size) - size + rows, size) + inner] = self.ids.all[np.repeat(begin, size) + inner]
        return out, counts


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens[, ids]: documents' ids cut every ``length`` ids.

    A null text counts as empty and has the end id alone.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches):
        encoder = held(f"ids {tokenizer_path}", lambda: WordIds(tokenizer_path))
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                ids, counts = encoder.texts(batch.column(1).slice(a, b - a), end_id)
                n = -(-counts // length)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, counts[doc] - start)
                bounds = np.append(0, np.cumsum(size))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                cols = [batch.column(0).take(pa.array(a + doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[doc])]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Leaves of the tournament tree hold the room left in each bin, inner nodes the larger child; the
    first bin with enough room is found by descending to the left wherever that suffices.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        at = node - leaves
        bins[i], offsets[i] = at, capacity - tree[node]
        used = max(used, at + 1)
        tree[node] -= size
        node //= 2
        while node:
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
            node //= 2
    return bins, offsets, used


def pack(pieces_df: DataFrame, length: int = 4096, group_rows: int = 16384) -> DataFrame:
    """Adds sequence_id and offset to pieces: no sequence is longer than ``length``, offsets have no gaps.

    Pieces are stored and counted, dealt out by a hash to ceil(count / group_rows) groups, and each group is
    packed alone, so that the result depends on the pieces and ``group_rows`` only, not on partitions. Rows
    of one hash (repeated ones) beyond two groups' worth are packed in parts of that size. Repeated rows are
    packed one by one; an empty table gives an empty result. Other columns are carried along.
    """
    stored, seen = measured(pieces_df, "pieces", n=F.count(F.lit(1)))
    n_groups = max(1, -(-seen["n"] // group_rows))
    dealt = stored.withColumn("_spread", F.xxhash64("doc_id", "start", "ids_crc32")).withColumn("_group", F.pmod("_spread", F.lit(n_groups)))
    dealt = dealt.repartition("_group").sortWithinPartitions("_group", "_spread", "doc_id", "start", "ids_crc32")
    names = [f.name for f in pieces_df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema.fields) + ", sequence_id long, offset long"
    most = 2 * group_rows

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """Rows of one group, at most ``most`` of them."""
        rows, count, own = [], 0, -1
        for b in batches:
            group = b.column("_group").to_numpy()
            while len(group):
                n = int(np.searchsorted(group, group[0], side="right"))
                if rows and (group[0] != own or count == most):
                    yield own, pa.Table.from_batches(rows)
                    rows, count = [], 0
                own, n = int(group[0]), min(n, most - count)
                rows.append(b.slice(0, n))
                count += n
                b, group = b.slice(n), group[n:]
        if rows:
            yield own, pa.Table.from_batches(rows)

    def run(batches):
        used, last = 0, -1
        for group, t in groups(batches):
            used = used if group == last else 0
            at, offset, more = first_fit_decreasing(t.column("length").to_numpy(), length)
            t = t.select(names).append_column("sequence_id", pa.array((group << 33) + used + at)).append_column("offset", pa.array(offset))
            used, last = used + more, group
            yield from t.to_batches()

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, group_rows: int = 16384, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``length`` ids."""
    return pack(pieces(docs, tokenizer_path, end_id, length, keep_ids=keep_ids), length, group_rows)

