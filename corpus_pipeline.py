"""Five stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents, also further ones whatever their names. Null and empty texts, and texts
without a letter, pass every stage. Rows with a null id pass as well; repeated rows are judged one by one,
but where a document goes for its copies or for what it holds, all rows of its id go. An empty table
passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweft.llm import decontam, linededup, ngram_join, packing, toxicity
from auditweft.llm.common import free, persisted, read
from auditweft.llm.queries import fold, tokenizer_file

#: SQL can't express the trained, latent and packing stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the network go; the network learns from labelled rows of two of three folds.

    Without labels of both kinds nothing goes.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~fold(3, 1))
    name = free(docs, "toxicity")
    return toxicity.scored(docs, model, out_col=name).filter(F.col(name) < 0.7).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines leave the texts (their first place keeps them); every document stays."""
    lines, dropped = free(docs, "n_lines"), free(docs, "n_dropped")
    out = linededup.drop_recurring_lines(docs, lines_col=lines, dropped_col=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked at a similarity of 0.8 over five-word shingles, the least doc_id stays."""
    found = ngram_join.jaccard_components(docs, k=5, num=80, den=100)
    gone = persisted(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or paraphrased, go."""
    found = decontam.find(docs, read(spark, sf_dir, "benchmark"))
    gone = persisted(found.select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents and their places in sequences of 4096."""
    return packing.pack_documents(docs, tokenizer_file(), end_id=2, length=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
