"""Decontamination: subsequences by the plain recurrence, recall against brute force, odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from auditweft.llm import decontam

SF = "/root/testdata/sf0.01"


def test_lcs_equals_plain_recurrence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(-1, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert decontam.lcs_length(a, b) == m[-1][-1]


def test_recall_of_copied_items(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()}
    norm = lambda t: " ".join(re.sub(r"[^\w\s]|[\d_]", "", t.lower()).split())
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    print(len(exact), len(found), len(exact - found), len(found - exact))
    assert len(exact) > 10 and len(exact & found) >= 0.98 * len(exact)
    for d, i in found - exact:  # near copies: most of the item's words in order
        assert decontam.lcs_length(items[i].split(), texts[d].split()) >= 0.5 * len(items[i].split())


def test_odd_rows(spark):
    words = [f"{a}{b}x" for a in "bcdfgklmnp" for b in "aeiou"]
    item = " ".join(words[:40])
    changed = " ".join(w if i % 5 else "other" for i, w in enumerate(words[:40]))
    docs = spark.createDataFrame(
        [(1, "before " * 70 + item + " after" * 70, 5), (1, "before " * 70 + item + " after" * 70, 5), (2, None, 5), (3, "", 5), (4, changed, 5), (5, "quite another text of words", 5), (None, item, 5)],
        "doc_id long, text string, item_id int",
    )
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect())
    assert got == [(1, 7), (4, 7)]
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


def _plain_found(texts, items, cosine=0.3, copied=0.7, loose=0.5):
    """Every passage against every item: cosine of the full vectors, then the subsequence rule."""
    vocab = {w for x in items.values() for w in x}
    windows = []
    for d, t in texts.items():
        for b in range(0, max(1, len(t) - 24), 24) if len(t) > 48 else [0]:
            windows.append((d, t[b : b + 48], t[max(0, b - 24) : b + 72]))
    df = Counter(w for _, p, _ in windows for w in set(p) & vocab)
    use = {w for w in vocab if df[w] <= max(50, 0.05 * len(windows))}
    for x in items.values():
        use |= set(sorted(set(x), key=lambda w: df[w])[:8])

    def vector(words):
        x = {w: (1 + math.log(c)) * (math.log((len(windows) + 1) / (df[w] + 1)) + 1) for w, c in Counter(words).items() if w in use}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        return {w: v / norm for w, v in x.items()}

    rows = {i: vector(x) for i, x in items.items()}
    ids = {w: n for n, w in enumerate(vocab)}
    near, possible = set(), set()
    for d, p, around in windows:
        v = vector(p)
        for i, x in items.items():
            if len(set(x) & set(around)) < 3:
                continue
            a, b = [ids[w] for w in x], [ids.get(w, -1) for w in around]
            share = decontam.lcs_length(a, b) / len(a)
            if share >= copied or share >= loose and decontam.lcs_length(a[-6:], b) >= 0.6 * len(a[-6:]):
                possible.add((d, i))
                if sum(u * rows[i].get(w, 0) for w, u in v.items()) >= cosine:
                    near.add((d, i))
    return near, possible


def test_more_items_than_the_rank_of_the_space(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(2500)]
    items = {i: rng.sample(words, rng.randint(8, 40)) for i in range(260)}
    texts = {d: [rng.choice(words) for _ in range(rng.randint(20, 200))] for d in range(500)}
    for d in range(260):
        copy = list(items[d])
        if d % 2:  # a third of the words replaced, the last six kept
            for j in rng.sample(range(len(copy) - 6), (len(copy) - 6) // 3):
                copy[j] = rng.choice(words)
        at = rng.randint(0, len(texts[d]))
        texts[d][at:at] = copy
    near, possible = _plain_found(texts, items)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()}
    print(len(near), len(possible), len(found), len(near - found))
    assert len(near) > 200 and near <= found <= possible


def test_recall_on_more_text(spark):
    docs, bench = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    norm = lambda t: " ".join(re.sub(r"[^\w\s]|[\d_]", "", t.lower()).split())
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    texts = {r.doc_id: norm(r.text or "") for r in docs.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    # every item once as it is and once with each sixth word replaced, between lines of the table's own texts
    own = [t for t in texts.values() if len(t) > 300]
    more, planted = [], set()
    for i, x in items.items():
        changed = " ".join("other" if j % 6 == 2 else w for j, w in enumerate(x.split()))
        for d, t in ((10**9 + 2 * i, x), (10**9 + 2 * i + 1, changed)):
            more.append((d, f"{own[i % len(own)][:150]} {t} {own[(i + 7) % len(own)][:150]}"))
            planted.add((d, i))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontam.find(every, bench).collect()}
    print("verbatim", len(exact), len(exact & found), "planted", len(planted), len(planted & found), "all", len(found))
    assert len(exact) > 100 and exact <= found
    assert len(planted & found) >= 0.99 * len(planted)


def test_copies_without_the_rarest_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1200)]
    texts = {d: [rng.choice(words) for _ in range(48)] for d in range(1600)}
    items, planted = {}, set()
    for i in range(20):
        item = rng.sample(words, 32)
        for j in range(8):
            item.insert(3 * j, f"rare{chr(97 + i)}{chr(97 + j)}")
        items[i] = item
        texts[5000 + i] = [rng.choice(words) for _ in range(20)] + ["other" if w.startswith("rare") else w for w in item]
        planted.add((5000 + i, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()} == planted


def test_chains_equal_enumeration():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(300):
        hits = [(rng.randint(0, 3), rng.randint(0, 5), rng.randint(1, 9)) for _ in range(rng.randint(0, 8))]
        best = 0
        for n in range(len(hits) + 1):
            for some in combinations(sorted(hits), n):
                if all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(some, some[1:])):
                    best = max(best, sum(h[2] for h in some))
        assert decontam.longest_chain(hits) == best


def test_items_longer_than_a_passage(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    sizes = [60, 64, 65, 90, 97, 130, 150, 250, 500, 900]
    items = {i: [rng.choice(words) for _ in range(n)] for i, n in enumerate(sizes)}
    texts, wanted = {}, set()
    fill = lambda: [rng.choice(words) for _ in range(rng.randint(20, 90))]
    for i, x in items.items():
        changed = [rng.choice(words) if j % 6 == 2 else w for j, w in enumerate(x)]
        for j, part in enumerate((x, changed, x[: len(x) // 2], x[len(x) // 2 :] + fill() + x[: len(x) // 2])):
            texts[100 * i + j] = fill() + part + fill()
            if j < 2:
                wanted.add((100 * i + j, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.lcs for r in decontam.find(docs, bench).collect()}
    assert wanted <= set(found)
    # halves don't pass as the whole, nor halves in the wrong order of items that a window can't hold
    assert not [d for d, _ in found if d % 100 == 2]
    assert not [(d, i) for d, i in found if d % 100 == 3 and sizes[i] > 130 and found[d, i] >= 0.7]
    assert all(0.5 <= v <= 1 for v in found.values())


def _mixed(spark, n=60):
    rng = random.Random(12)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    items = {i: [rng.choice(words) for _ in range(rng.choice([12, 30, 90]))] for i in range(n)}
    texts = {d: [rng.choice(words) for _ in range(30)] + [w if rng.random() < 0.8 else "other" for w in items[d % n]] + [rng.choice(words) for _ in range(30)] for d in range(2 * n)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")


def test_chunks_of_items_give_equal_rows(spark, monkeypatch):
    docs, bench = _mixed(spark)

    def found(items, words):
        monkeypatch.setattr(decontam, "ITEMS", items)
        monkeypatch.setattr(decontam, "LATENT_WORDS", words)
        return {(r.doc_id, r.item_id): (r.lcs, r.cosine) for r in decontam.find(docs, bench).collect()}

    whole = found(2000, 1 << 16)
    assert len(whole) > 90
    for words in (1 << 16, 300):
        one, three = found(2000, words), found(20, words)
        assert set(one) == set(three) == set(whole)
        assert all(one[k][0] == three[k][0] and abs(one[k][1] - three[k][1]) < 1e-3 for k in one)


def test_the_space_raises_cosines_of_related_words():
    """Dense check: the cosine in the span of vectors and item, against projection by least squares."""
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(40, 6)))[0]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    passages, items = unit(rng.random((50, 40))), unit(rng.random((50, 40)))
    got = decontam.latent_cosines((passages * items).sum(1), passages @ basis, items @ basis)
    for v, x, c in zip(passages, items, got):
        q = np.linalg.qr(np.column_stack([basis, x]))[0]
        assert abs(c - q.T @ v @ (q.T @ x) / np.linalg.norm(q.T @ v)) < 1e-9 and c >= v @ x - 1e-12
    inside = unit((basis @ rng.normal(size=(6, 1))).T)
    assert abs(decontam.latent_cosines(inside @ inside[0], inside @ basis, inside @ basis)[0] - 1) < 1e-9


def test_too_many_items_are_refused(spark, monkeypatch):
    docs, bench = _mixed(spark, 4)
    monkeypatch.setattr(decontam, "ITEM_CHARS", 10)
    with pytest.raises(ValueError, match="several calls"):
        decontam.find(docs, bench)
