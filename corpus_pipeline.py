"""A training-data pipeline of five corpus operators; every stage reads what its predecessor kept.

Near copies: line dedup comes first and deletes what they share, so the n-gram stage sees only what line dedup left of them.

Defined cases: a null or empty text passes toxicity, line dedup, the n-gram stage (in which a wordless row is alone) and decontamination, and is packed as one token; very long texts, repeated rows, null ids and
extra columns, whatever their names are, follow the operators' own definitions; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontaminate, line_runs, prefix_join, toxic_segments, two_fit
from cohortspark.llm.common import doc_table
from cohortspark.scratch import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxic_segments.reject_toxic(docs, doc_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents of which no word is left go."""
    d = line_runs.dedup_lines(docs)
    return d.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return prefix_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which no word is left go."""
    return decontaminate.remove_spans(docs, doc_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row per piece."""
    return two_fit.pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]

#: Tokenisers, learnt weights and packing have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs, at = doc_table(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:  # what was read is written anew now: its space is given back
            spark.createDataFrame([], spark.read.parquet(before).schema).write.mode("overwrite").parquet(before)
        before = f"{at}/{name}"
    return docs
