"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage gets what the one before it kept, as Parquet, and all but the last return the columns of
documents. Stages write below the shared folder of spark.checkpoint.dir when ``run`` is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquill.llm import cotraining, jaccard, line_dedup, mixing, packing
from parquill.runtime import remove, shared_folder, table

def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one of them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, stats_col=None)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar sets of five-word shingles (0.8 or more), one stays."""
    return jaccard.near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: file k holds the k-th range of the schedule, in order."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, which follow the schedule by ``order`` and ``sequence_id``.

    ``order`` is the mixed file's number and, where a file is read in several pieces, the piece's place in
    it. Within windows of about a million tokens documents change places to fill sequences. Where ``docs``
    is not read from Spark's part files, as in tests, all have order 0.
    """
    part = F.coalesce(F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).try_cast("long"), F.lit(0))
    return packing.pack_documents(docs, order=part * (1 << 40) + F.input_file_block_start())


STAGES = [("quality", good_quality), ("line_dedup", unique_lines), ("near_duplicates", one_of_similar), ("mixing", mixed), ("packing", packed)]

#: A fitted classifier, a schedule and a heuristic are not SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written; the last one's input stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
