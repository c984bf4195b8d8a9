"""Corpus preparation in five stages over ``documents``: what each one rejects or cuts is gone.

Toxic documents go; passages and line chunks that repeat are cut from all texts but the first; of
each group of near-duplicates (found by the anchors of SimHash, and by further signatures where they differ in more
bits; decided on five-word shingles at a similarity of 0.8) the smallest id stays; documents
that hold a benchmark item go; the rest is packed into sequences. Every stage but the last returns
the columns of ``documents``. A stage's result is written as Parquet in the folder that the cluster
shares and read back for the next one, so a lost executor costs at most the current stage. A stage's
input is deleted when the next result is there.

Null and empty texts are no reason to go in any stage: they have no toxic word, no line, no benchmark
item; but they are copies of each other, so one of them stays. Rows repeated with id and text count as
one from near-dedup on; equal texts under other ids are copies. Columns may have any names, and all are
kept until packing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.llm.common import delete, fresh, scratch_path, table
from thoughtloom.llm.decontaminate import remove_leaks
from thoughtloom.llm.linededup import remove_repeated_chunks
from thoughtloom.llm.packing import best_fit
from thoughtloom.llm.similar import keep_first
from thoughtloom.llm.toxicity import fit_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "toxicity")
    return model.score(docs, column=score).where(F.col(score) < 0.5).drop(score)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those of which nothing is left go, n_chars follows."""
    (removed,) = fresh(docs.columns, "removed")
    cut = remove_repeated_chunks(docs, counted=removed)
    left = cut.where((F.col(removed) == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(removed)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id."""
    return keep_first(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers or names."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, n_words, bin_id, slot."""
    return best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-dedup", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained models, content-defined chunks and best-fit search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
