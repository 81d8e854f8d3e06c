"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is
written as Parquet and read again for the next one. All stages but the last return the columns of
`documents`. Rows with a null id or text pass through the filters that can't judge them. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, decontam, linededup, ngram_join, quality
from keyloom.llm.common import discard, materialise, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below its threshold."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, out_col="_score").where(F.col("_score") >= model.threshold).drop("_score")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines out of the texts; n_chars becomes the length of what is left."""
    out = linededup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (Jaccard 0.8 or more), the smallest id stays.

    Rows that repeat an id are one document, judged by the one with most shingles; they stay or go together.
    """
    groups = ngram_join.near_duplicates(docs, k=5, num=80, den=100)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text."""
    return bpe.digest(docs, bpe.load_vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: Bytes of rows that a stage's last step hands to Python at a time: whole documents pass through with all their columns.
BATCH = 4 << 20

#: The classifier can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name, BATCH)
        discard(before)
    return docs
