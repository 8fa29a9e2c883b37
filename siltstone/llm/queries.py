"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.alignment import alignment_digest
from siltstone.llm.conversations import REPAIR_SQL, repair_digest
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.html_text import page_texts
from siltstone.llm.language import language_digest
from siltstone.llm.licenses import LICENSE_SQL, licenses
from siltstone.llm.mixing import MIX_SQL, mix_digest
from siltstone.llm.near_dedup import NEAR_SQL, near_duplicates
from siltstone.llm.packing import packing_digest
from siltstone.llm.quality_model import quality_digest
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.sharding import shard_digest
from siltstone.llm.toxicity import toxicity_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


def op4_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _table(spark, sf_dir, "documents"))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op10_shard_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"), 8)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(spark, _table(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(spark, _table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_curriculum": op1_mix_curriculum,
    "op2_html_main_text": op2_html_main_text,
    "op3_license_sentences": op3_license_sentences,
    "op4_language_cnn": op4_language_cnn,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_nbsvm": op6_quality_nbsvm,
    "op7_greedy_string_tiling": op7_greedy_string_tiling,
    "op8_toxicity_automata": op8_toxicity_automata,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_shard_prefix_sums": op10_shard_prefix_sums,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_curriculum": MIX_SQL,
    "op3_license_sentences": LICENSE_SQL,
    "op9_minhash_near_dedup": NEAR_SQL,
    "op11_conversation_repair": REPAIR_SQL,
}
