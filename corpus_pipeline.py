"""The corpus pipeline: five stages, each one operator over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import line_dedup, mixing, near_dedup, pieces, quality_rules
from strandwork.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and wordless texts among them. Repeated rows are judged alike; a null lang is held against all documents."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which no word is left goes.

    The first copy is that of the smallest doc_id (null first), of equal ones by a hash of the row; repeated rows are copies.
    """
    return line_dedup.keep_rest(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Rows that share that doc_id all stay; a group without any doc_id keeps one row.
    """
    return near_dedup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, the last; rows that share a doc_id go together."""
    return mixing.keep_taken(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and what they decode to; a null text has none."""
    return pieces.encode_and_back(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mix), ("pieces", encode)]

#: SQL has no near-duplicate groups at this size and no piece segmentation; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
