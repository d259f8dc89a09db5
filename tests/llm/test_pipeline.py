"""The pipeline: columns kept by every stage, planted cases, odd rows, whole coverage of what remains."""

import corpus_pipeline
import pytest
from auditweft.llm import toxicity
from auditweft.llm.common import persisted
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = persisted(stage(spark, now, SF))
        assert after.schema == docs.schema, name
        assert after.join(now, "doc_id", "left_anti").count() == 0
        gone = now.join(after, "doc_id", "left_anti")
        if name == "toxicity":
            marked = {r.toxic: (r.all, r.gone) for r in docs.join(labels, "doc_id").join(gone.select("doc_id", F.lit(1).alias("g")), "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("all"), F.count("g").alias("gone")).collect()}
            print("documents and rejected by label", marked)
            assert marked[1][1] > 0.7 * marked[1][0] and marked[0][1] < 0.05 * marked[0][0]
        if name == "line_dedup":
            assert gone.count() == 0
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in now.select("doc_id").collect()}
    per_doc = packed.groupby("doc_id").agg(n=("length", "sum"), total=("doc_tokens", "first"))
    assert (per_doc.n == per_doc.total).all()
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and fill.sum() / (4096 * len(fill)) > 0.8


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "123 .. !!", None, None, 9), (4, long, "en", "s", 1), (5, "two words", "en", "s", 9), (5, "two words", "en", "s", 9), (None, "a row without an id", "en", "s", 19), (6, " \n\n ", "en", "s", 4)]
    return spark.createDataFrame([(*r, 0.5, "x", "y", "t", 7, "g") for r in rows], COLUMNS + ", score double, _score string, `odd.name` string, _toxicity string, N_Dropped long, _gone string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_columns_pass_every_stage(spark, odd, name, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)[name]
    if name == "toxicity":  # trained once on the small tables: the odd rows have no labels
        docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
        model = toxicity.train(docs, labels, F.lit(True))
        monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *a, **k: model)
    out, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, None}
        return
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "x30 ")
    rows = [(1, text, "en", "s", 1), (2, near, "en", "s", 1), (2, near, "en", "s", 1), (3, "something else entirely is written in here", "en", "s", 1), (3, "something else entirely is written in here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3, 3]


def test_whole_run_is_its_stages_one_by_one(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and len(out)
    assert corpus_pipeline.ORACLE_SQL is None
