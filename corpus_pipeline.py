"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece ids.

Every stage but the last takes and returns the columns of documents, and works on all that its predecessor kept.

Edge cases, the same in all stages: null, empty and blank texts go with the quality rules or have no piece; repeated rows
are treated alike; a null id is never a copy of another; very long texts are read whole; other columns pass through, and
names that clash with working columns do not matter; ties go to the least id, then line; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import decontaminate, line_dedup, ngram_join, pieces, quality_rules
from massloom.session import reach_workers


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of which an earlier document, or line, has a copy or near copy.

    Those without a word left, all of whose lines stand elsewhere, go.
    """
    return line_dedup.dedup(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    reach_workers(spark)
    return ngram_join.keep_one(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    reach_workers(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes, round_trip."""
    reach_workers(spark)
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", unique_documents),
    ("benchmark decontamination", unseen_documents),
    ("SentencePiece encoding", piece_ids),
]

#: EM, MinHash classes and Viterbi are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
