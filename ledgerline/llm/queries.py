"""The operators applied to the test tables with production parameters: opN_<name>, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_shard_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=40)


def op2_mix_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_pack_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removals

    return removals(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    groups = jaccard_groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10)


def op12_chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import by_conversation, canonical_turns, digests, formatted

    said = r"\### Assistant: </turn> ok"
    one = spark.createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role string, content string>>")
    records = by_conversation(table(spark, sf_dir, "conversations")).unionByName(one, allowMissingColumns=True)
    return digests(formatted(canonical_turns(records, "conv_id")), "conv_id")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, top=2000)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def llm_oracle_sql() -> dict[str, str]:
    from . import chat, clustering, collocations, sharding, urls

    return {
        "op1_shard_prefix_sums": sharding.oracle(),
        "op4_url_reputation": urls.oracle(),
        "op11_delta_lloyd": clustering.oracle(),
        "op12_chat_fingerprints": chat.oracle(),
        "op13_phrase_collocations": collocations.oracle(),
    }
