"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``.

Defined cases: rows that a filtering stage can't judge (no text, no id) are clean
and stay; equal rows are judged alike, except that one of a group of near
duplicates stays, and of rows that share an id; an empty table passes through;
further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import finished, read, scratch, short_batches
from tamarack.llm.decontaminate import decontaminate
from tamarack.llm.neardup import near_duplicates
from tamarack.llm.packing import packed_documents
from tamarack.llm.pii import redact
from tamarack.llm.toxicity import fit_from_tables, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the network learns from all labels."""
    short_batches(spark)
    model = fit_from_tables(docs, read(spark, sf_dir, "labels"), F.lit(False))
    scored = score_toxicity(docs.select(*COLUMNS, F.col("text").alias("scored_text")), model, "scored_text")
    return scored.where("score < 0.5").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates (5-word shingles, 0.8).

    Rows that share an id are one document; that with the least text stays.
    """
    found = finished(spark, lambda: near_duplicates(docs, k=5, num=80, den=100).select("doc_id", "kept"), "kept")
    dropped = found.where("not kept").select("doc_id").distinct()
    # texts move once, by their ids, for the join and for rows that share one; "merge", as ids to broadcast grow with the table
    kept = docs.where("doc_id is not null").select(COLUMNS).join(dropped.hint("merge"), "doc_id", "left_anti")
    one = kept.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return docs.where("doc_id is null").select(COLUMNS).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text."""
    return redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 1024 tokens."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fitted network and the latent search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
