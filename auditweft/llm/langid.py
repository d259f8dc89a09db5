"""Language of every word by a linear-chain conditional random field, and of texts by their words.

Unary weights come from affixes, byte n-grams and the word itself (lexicon), hashed into buckets;
transition weights are learned. Forward-backward over a whole text gives each word's label
distribution; a text's language is the one with the most expected words. Texts are one chain whatever
their length: pieces of a chain are worked on side by side, and products of their transfer matrices
carry the exact messages from piece to piece.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, slices
from .textnum import raw_bytes, word_bounds
from .words import WordTable, letters_only, ngram_buckets

BUCKETS = 1 << 16
#: Words of a piece of a chain; results don't depend on it.
PIECE = 64
#: Words worked on at once by forward-backward.
WORDS_AT_ONCE = 1 << 18


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return ngram_buckets(words, (1, 2, 3, 4), BUCKETS, start_only=(5,), whole=True)


def forward_backward(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label marginals [S,T,L], expected transition counts [L,L], log normaliser [S]) of masked chains.

    Words with mask 0 only follow a chain's end.
    """
    s, t, n = unary.shape
    top = unary.max(2, keepdims=True)
    e = np.exp(unary - top)
    m = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.ones((s, t), e.dtype)
    a = e[:, 0]
    for i in range(t):
        if i:
            a = np.where(mask[:, i, None], e[:, i] * (alpha[:, i - 1] @ m), alpha[:, i - 1])
        z = a.sum(1)
        scale[:, i] = z
        alpha[:, i] = a / z[:, None]
    pairs = np.zeros((n, n))
    for i in range(t - 2, -1, -1):
        live = mask[:, i + 1, None]
        right = e[:, i + 1] * beta[:, i + 1]
        back = right @ m.T / scale[:, i + 1, None]
        beta[:, i] = np.where(live, back, 1)
        joint = (alpha[:, i] * mask[:, i + 1, None]).T @ (right / scale[:, i + 1, None])
        pairs += joint * m
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    logz = (np.log(scale) + top[:, :, 0] * mask).sum(1)
    return gamma * mask[:, :, None], pairs, logz


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def chain_marginals(unary: np.ndarray, rows: np.ndarray, trans: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Label marginals [W,L] of words with unary weights [W,L]; equal neighbours in ``rows`` form one chain.

    Each chain is cut into pieces. The pieces' transfer matrices are multiplied up side by side, messages
    at the borders follow piece by piece over all chains at once, and forward-backward then runs in all
    pieces from these messages.
    """
    w, n = unary.shape
    e = np.exp(unary - unary.max(1, keepdims=True)).astype(np.float64)
    m = np.exp(trans.astype(np.float64))
    place = np.arange(w) - np.searchsorted(rows, rows, side="left")
    begin = np.flatnonzero(place % piece == 0)
    size = np.diff(np.append(begin, w))
    order = place[begin] // piece
    s, t = len(begin), int(size.max())
    mask = np.arange(t)[None] < size[:, None]
    em = np.ones((s, t, n))
    em[mask] = e
    # what the label before a piece makes of the label at its end
    carry = np.broadcast_to(np.eye(n), (s, n, n)).copy()
    for i in range(t):
        live = mask[:, i]
        carry[live] = _scaled((carry[live] @ m) * em[live, i][:, None, :])
    first, last = order == 0, np.append(order[1:] == 0, True)
    into, back = np.ones((s, n)), np.ones((s, n))
    by_order = np.argsort(order, kind="stable")
    steps = np.split(by_order, np.flatnonzero(np.diff(order[by_order])) + 1)
    # the first piece of a chain has no label before it; its transfer starts at its first word
    start = em[:, 0] / em[:, 0].sum(1, keepdims=True)
    inner = np.broadcast_to(np.eye(n), (s, n, n)).copy()
    for i in range(1, t):
        live = mask[:, i] & first
        if live.any():
            inner[live] = _scaled((inner[live] @ m) * em[live, i][:, None, :])
    out = np.empty((s, n))
    for k, part in enumerate(steps):
        if k == 0:
            out[part] = _scaled((start[part][:, None, :] @ inner[part])[:, 0])
        else:
            into[part] = out[part - 1]
            out[part] = _scaled((into[part][:, None, :] @ carry[part])[:, 0])
    for part in reversed(steps):
        inside = part[~last[part]]
        back[inside] = _scaled((carry[inside + 1] @ back[inside + 1][:, :, None])[:, :, 0])
    alpha, beta = np.empty((s, t, n)), np.empty((s, t, n))
    a = np.where(first[:, None], start, _scaled((into @ m) * em[:, 0]))
    alpha[:, 0] = a
    for i in range(1, t):
        a = np.where(mask[:, i, None], _scaled((a @ m) * em[:, i]), a)
        alpha[:, i] = a
    b = back
    beta[:, t - 1] = b
    for i in range(t - 2, -1, -1):
        b = np.where(mask[:, i + 1, None], _scaled((em[:, i + 1] * b) @ m.T), b)
        beta[:, i] = b
    return _scaled((alpha * beta)[mask])


class Crf:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.w = np.zeros((BUCKETS, len(labels)), np.float32)
        self.t = np.zeros((len(labels), len(labels)), np.float32)

    def unary(self, words: list[str]) -> np.ndarray:
        ids, first = _grams(words)
        return np.add.reduceat(self.w[ids], first, axis=0)

    def fit(self, chains: list[list[tuple[str, list[str]]]], epochs: int = 6, rate: float = 0.15, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> "Crf":
        """Chains are runs of words, each with its label; a chain of more runs switches between labels."""
        rng = np.random.default_rng(seed)
        gw, gt = np.full(self.w.shape, 1e-2, np.float32), np.full(self.t.shape, 1e-2)
        label = {x: i for i, x in enumerate(self.labels)}
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // batch)):
                words = [w for i in part for _, run in chains[i] for w in run]
                lens = np.array([sum(len(run) for _, run in chains[i]) for i in part])
                ids, first = _grams(words)
                mask = np.arange(lens.max())[None] < lens[:, None]
                y = np.zeros(mask.shape, np.int64)
                y[mask] = [label[x] for i in part for x, run in chains[i] for _ in run]
                unary = np.zeros((*mask.shape, len(self.labels)), np.float32)
                unary[mask] = np.add.reduceat(self.w[ids], first, axis=0)
                gamma, pairs, _ = forward_backward(unary, mask, self.t)
                diff = -gamma
                np.put_along_axis(diff, y[:, :, None], np.take_along_axis(diff, y[:, :, None], 2) + mask[:, :, None], 2)
                per_gram = np.repeat(diff[mask], np.diff(np.append(first, len(ids))), axis=0) / len(part)
                grad = np.stack([np.bincount(ids, per_gram[:, k], BUCKETS) for k in range(len(self.labels))], 1).astype(np.float32) - decay * self.w
                gw += grad**2
                self.w += rate * grad / np.sqrt(gw)
                seen = np.zeros_like(self.t)
                np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
                gradt = (seen - pairs) / len(part) - decay * self.t
                gt += gradt**2
                self.t += (rate * gradt / np.sqrt(gt)).astype(np.float32)
        return self


def spliced(runs: list[tuple[str, list[str]]], share: float = 0.3, seed: int = 3) -> list[list[tuple[str, list[str]]]]:
    """Chains of one run, and for ``share`` of them chains of the starts and ends of two runs of different labels."""
    rng = np.random.default_rng(seed)
    out = [[r] for r in runs]
    for i in np.flatnonzero(rng.random(len(runs)) < share):
        other = runs[int(rng.integers(len(runs)))]
        if other[0] != runs[i][0] and min(len(other[1]), len(runs[i][1])) > 2:
            a, b = (int(rng.integers(1, len(r[1]))) for r in (runs[i], other))
            out.append([(runs[i][0], runs[i][1][:a]), (other[0], other[1][b:])])
    return out


def train(docs: DataFrame, rows: Column, id_col: str, text_col: str, lang_col: str, docs_per_label: int = 1500, chains_per_doc: int = 3, words_per_chain: int = 32) -> Crf | None:
    """Fit on at most about ``docs_per_label`` labelled documents per language, chosen by a hash of
    the id among the rows where ``rows`` holds, and ``chains_per_doc`` runs of words from each; runs of
    different languages are spliced as well, so that switches are learned."""
    own = docs.filter(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["y"]: r["count"] for r in own.groupBy(F.col(lang_col).cast("string").alias("y")).count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(int(1e6 * min(1, docs_per_label / v))))]), F.col(lang_col).cast("string"))
    picked = own.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(17))).filter(F.pmod("_h", F.lit(1_000_000)) <= share)

    def run(batches):
        for batch in batches:
            labels, out, keys = [], [], []
            for text, lang, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = [w for w in letters_only([w.encode() for w in text.split()]) if w]
                starts = range(0, len(words), words_per_chain)
                for k in sorted(starts, key=lambda a: (a * 2654435761 + h) % 1000003)[:chains_per_doc]:
                    labels.append(lang)
                    out.append(words[k : k + words_per_chain])
                    keys.append((h + k * 7919) % (1 << 62))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["y", "h", "words"])

    chains = picked.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"), "_h").mapInArrow(run, "y string, h long, words array<string>")
    rows_ = chains.orderBy("h", "y").limit(int(1.5 * docs_per_label * chains_per_doc * len(counts))).collect()
    if not rows_:
        return None
    return Crf(sorted({r["y"] for r in rows_})).fit(spliced([(r["y"], r["words"]) for r in rows_ if r["words"]]))


def word_labels(model: Crf, text: str) -> list[tuple[str, str]]:
    """(word, likeliest label) of a text's words with a letter, by forward-backward over the whole text."""
    words = [w for w in letters_only([w.encode() for w in text.split()]) if w]
    if not words:
        return []
    unary = model.unary(words)[None].astype(np.float32)
    gamma, _, _ = forward_backward(unary, np.ones((1, len(words)), bool), model.t)
    return [(w, model.labels[k]) for w, k in zip(words, gamma[0].argmax(1))]


def _label_batch(model: Crf, table: WordTable, col: pa.Array):
    """Per slice: first row, per row expected words per label [R,L], and runs of words with one likeliest label as
    (row, label, words) arrays in text order."""
    n = len(model.labels)
    for a, b in slices(col, 1 << 20):
        data, bounds = raw_bytes(col.slice(a, b - a))
        starts, ends, rows = word_bounds(data, bounds)
        mass, runs = np.zeros((b - a, n)), []
        if len(starts):
            derived, at = table.index(data, starts, ends)
            keep = derived[at, n] > 0
            at, rows = at[keep], rows[keep]
        if len(starts) and len(at):
            ends_of = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) + 1
            lo = 0
            while lo < len(at):
                # whole texts together, as many as fit; one longer than that alone
                fit = ends_of[(ends_of > lo) & (ends_of <= lo + WORDS_AT_ONCE)]
                hi = int(fit[-1]) if len(fit) else int(ends_of[ends_of > lo][0])
                gamma = chain_marginals(derived[at[lo:hi], :n], rows[lo:hi], model.t)
                for k in range(n):
                    mass[:, k] += np.bincount(rows[lo:hi], gamma[:, k], b - a)
                best, own = gamma.argmax(1), rows[lo:hi]
                first = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (own[1:] != own[:-1])))
                runs.append((own[first], best[first], np.diff(np.append(first, hi - lo))))
                lo = hi
        yield a, mass, [np.concatenate(x) for x in zip(*runs)] if runs else [np.zeros(0, np.int64)] * 3


def identify(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Crf | None = None, **fit) -> DataFrame:
    """Per row: doc_id, lang_pred, score, shares (expected share of words per language), runs (of neighbouring
    words with one likeliest language, in text order; only words with a letter count).

    ``lang_col`` is read only where ``train_rows`` holds. A text that is null or has no letter gets
    ``und`` and score 0, and so does every text if nothing could be learned. Null ids and repeated
    rows are kept; other columns are ignored.
    """
    model = model or train(docs, train_rows, id_col, text_col, lang_col, **fit)
    labels = model.labels if model else []
    name = f"language {uuid.uuid4().hex}"

    def derive(words: list[str]) -> np.ndarray:
        return np.column_stack([model.unary(words), [float(w != "") for w in words]]).astype(np.float32)

    def run(batches):
        for batch in batches:
            mass = np.zeros((batch.num_rows, max(1, len(labels))))
            found = [(np.zeros(0, np.int64),) * 3]
            if model is not None:
                for a, part, (row, label, words) in _label_batch(model, held(name, lambda: WordTable(derive)), batch.column(1)):
                    mass[a : a + len(part)] = part
                    found.append((a + row, label, words))
            row, label, words = (np.concatenate(x) for x in zip(*found))
            per_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            langs = pa.array(labels or [""], pa.string()).take(pa.array(label))
            items = pa.StructArray.from_arrays([langs, pa.array(words.astype(np.int64))], names=["lang", "words"])
            runs = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), items)
            total = mass.sum(1)
            share = mass / np.maximum(total, 1e-9)[:, None]
            best = share.argmax(1)
            pred = [labels[k] if t > 0 else "und" for k, t in zip(best, total)]
            shares = [list(zip(labels, s)) if t > 0 else [] for s, t in zip(share.tolist(), total)]
            score = np.clip(np.where(total > 0, share.max(1), 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64())), runs],
                names=["doc_id", "lang_pred", "score", "shares", "runs"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>, runs array<struct<lang:string,words:long>>")
