"""N-gram Jaccard join against brute force, and odd inputs."""

import random
import re

from auditweft.llm.ngram_join import jaccard_components


def shingles(text, k):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, k))
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and den * len(x & y) >= num * len(x | y):
                        ra, rb = root(a), root(b)
                        comp[max(ra, rb)] = min(ra, rb)
    return {d: (max(len(s) for s in sets[d]), root(d)) for d in ids}


def corpus(seed, n_groups=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 12, 60, 140]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rows += [passage + " " + " ".join(word() for _ in range(rng.randint(2, 12))) for _ in range(25)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    for seed, k, num, den in ((1, 4, 85, 100), (2, 5, 80, 100)):
        rows = corpus(seed)
        out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k, num, den)


def test_odd_rows_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (3, text, 2), (3, text, 2), (7, None, 3), (8, "", 4), (9, " \t ", 5), (10, "Hi", 6), (11, "hI", 7), (None, "alone here", 8), (12, "word " * 60_000, 9)]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == {5: (4, 3), 3: (4, 3), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10), None: (1, None), 12: (1, 12)}


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_and_null_ids_follow_their_own_texts(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: " ".join([*t[:-1], "changed"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (20, near(a)), (21, near(b)), (None, " ".join(c)), (30, near(c)), (None, " ".join(d)), (None, near(d)), (40, "some other words that stand alone")]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {7: {7}, 20: {7}, 21: {7}, None: {30, None}, 30: {30}, 40: {40}}
    # two texts of one id are different components, though they have the same name
    alone = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, near(b))]
    out = jaccard_components(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (5, 1), (5, 5), (9, 5)]
