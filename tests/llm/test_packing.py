"""Packing: exact ids, whole coverage, little padding, odd inputs."""

import zlib

import numpy as np
import pytest
from auditweft.llm import packing
from auditweft.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def packed(spark):
    texts = [
        (1, "Hello, world. It's THE don't stop... x.y,z 12.5, naïve ΣΑΣ, ok", "a"),
        (2, None, "b"),
        (3, "", None),
        (4, "one\x1ctwo three​four <|endoftext|> end", "c"),
        (5, "The and attion to thanedble the, anea. " * 1500, "c"),
        (6, "Öung tezu der. Enkeit! (tepf) — gekeit; ‘quoted’ café", "c"),
        (6, "Öung tezu der. Enkeit! (tepf) — gekeit; ‘quoted’ café", "c"),
        (None, "no id", "c"),
    ] + [(10 + i, "word " * (i % 97 + 1), "d") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, length string")
    return texts, packing.pack_documents(df, tokenizer_file(), keep_ids=True).toPandas()


def test_ids_equal_the_tokenizers(packed):
    from tokenizers import Tokenizer

    texts, out = packed
    t = Tokenizer.from_file(tokenizer_file())
    for doc, text, _ in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        rows = out[out.doc_id.isna()] if doc is None else out[out.doc_id == doc]
        rows = rows.drop_duplicates("start").sort_values("start")
        assert np.concatenate(list(rows.ids)).tolist() == ids
        assert (rows.doc_tokens == len(ids)).all()
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_sequences_are_gapless_and_full(packed):
    _, out = packed
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], s.length.cumsum()[:-1]]).tolist()
        assert s.length.sum() <= 4096
    assert len(out[out.doc_id == 6]) == 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        sizes = rng.integers(1, 60, n)
        bins, offsets, used = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - room[b])
            room[b] -= sizes[i]
        assert used == len(room)


def test_random_strings_equal_the_tokenizers():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = ["a", "B", "é", "É", "ß", "İ", "Σ", "ς", " ", "\n", "\t", "\x1c", "\x85", " ", " ", "﻿", "​", "'s", "'LL", "1", "９", "!", "<|endoftext|>"]
    parts += ["<|ENDOFTEXT|>", "<|startoftext|>", "<", "|", "́", "ﬁ", "中", "😀", ".", ",", "_", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    own, t = packing.WordIds(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    want = [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]
    ids, counts = own.texts(pa.array(texts), 2)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    own.known.cap = 500  # words are forgotten and learned again
    for a in range(0, 5000, 500):
        ids, counts = own.texts(pa.array(texts[a : a + 500]), 2)
        assert ids.tolist() == [i for x in want[a : a + 500] for i in x]


def test_little_padding_on_the_given_table(spark):
    out = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_file()).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert fill.sum() / (4096 * len(fill)) > 0.97


def test_groups_do_not_depend_on_settings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = packing.pack_documents(docs.repartition(int(n) // 3), tokenizer_file(), group_rows=300).collect()
            found.append(sorted((r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows))
            fill = packing.pack_documents(docs, tokenizer_file()).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").agg({"n": "avg"}).first()[0]
            assert fill / 4096 > 0.97
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len({s >> 33 for _, _, _, s, _ in found[0]}) >= 3


def test_many_repeated_rows_are_packed_in_parts(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "one two three")] * 500, "doc_id long, text string"), tokenizer_file(), length=16, group_rows=20).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 500
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 16
