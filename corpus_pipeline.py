"""A corpus from raw documents to packed token sequences, in five stages, each by an operator of ``stratapanel.llm``.

Each stage works on all that its predecessor kept. A filtering stage passes rows through with all their columns; the row's
own text decides, so repeated or null ids are judged like any row. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratapanel.llm import ngram_join, packing, quality, rules, suffix_dedup
from stratapanel.llm.common import fold, staged

ORACLE_SQL = None  # no stage is expressible in SQL; tests compare with brute force


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks good; without labels all stay."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(3) != 1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of similar ones."""
    return ngram_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat; bytes of a character that was cut in the middle go too."""
    return suffix_dedup.cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates),
          ("suffix_array_dedup", suffix_array_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
