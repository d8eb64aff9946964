"""The corpus pipeline: quality rules, near-duplicates, substring removal, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return the columns of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import common, decontaminate, simhash_similar, packing, quality, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed.  Null and empty texts fail; every row is judged by
    itself, so null and shared ids, ties and repeated rows change nothing; an empty table stays empty."""
    found = quality.judge(docs.select(*COLUMNS)).where("_q_kept")
    return found.select("doc_id", F.col("_q_cleaned").alias("text"), "lang", "source", F.length("_q_cleaned").cast("bigint").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (SimHash on five-word shingles, Jaccard 0.8 or more) stays: its smallest id,
    null ids last, then by content.  Rows that share an id are told apart; null, empty and white-space texts are one group."""
    return simhash_similar.first_of_each(docs, COLUMNS)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id holds too are cut out; documents with nothing left go, those that had no words
    before stay.  Rows without an id come last; rows of one id are one document and keep their words."""
    found, name = substring_dedup.remove_repeats(docs.select(*COLUMNS), keep=COLUMNS)
    s = F.col(name)
    text = F.when(s["n_removed"] == 0, F.col("text")).otherwise(s["kept"])
    left = found.where((s["n_removed"] == 0) | (s["n_removed"] < s["n_words"])).withColumn("text", text)
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span with the benchmark go; null and empty texts share none.  Rows are judged one by one."""
    found, name = decontaminate.find_leaks(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.col(name)["n_hit"] == 0).select(*COLUMNS)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of token windows; a null text is empty and holds the end id only; every row is packed."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_removal), ("decontamination", benchmark_removal), ("packing", window_packing)]

#: the last stage's tokens and windows are beyond SQL; tests compare the run with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared checkpoint folder."""
    common.ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
