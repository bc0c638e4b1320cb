"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join
    return join(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .language_id import identify
    return identify(table(spark, sf_dir, "documents"), fold(4) != 2, fold(4) == 2)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_digest
    return dedup_digest(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .quality import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) != 1, fold(3) == 1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge
    return judge(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode_decode
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .lm_score import score
    return score(table(spark, sf_dir, "documents"), fold(7) == 2)


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from .ann import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie
    return trie(table(spark, sf_dir, "conversations"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .toxicity import score
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2, fold(4) == 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    from .filter_audit import SQL as audit
    from .prefix_trie import SQL as trie
    return {"op11_conversation_prefix_trie": trie, "op12_filter_interaction_audit": audit}
