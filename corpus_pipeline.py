"""Documents to training shards, stage by stage; each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, language, mixing, near_dedup, sharding
from siltstone.llm.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no recognised language, go; so do null and empty texts.

    Repeated rows fare alike.  Any columns are carried through, whatever their names.
    """
    return language.with_known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Texts without words and null doc_ids are in no group and stay; repeated rows of the document
    that stays all stay.  Any columns are carried through.
    """
    return near_dedup.keep_one_of_each(spark, docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark passages go, with all rows of their doc_id.

    Null and empty texts and null doc_ids stay.  Any columns are carried through.
    """
    return decontaminate.without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, repeated or left out as the mix of sources asks.

    A null source is a source; documents without words come only with a full pass of their source.
    Any columns are carried through.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size (bytes), shard and slot, which replace columns of these names.

    Null texts have one byte; repeated rows each get a slot of their own.
    """
    return sharding.shard(docs, N_SHARDS, sharding.text_bytes())


N_SHARDS = 8

STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("mix", mixed_sources),
    ("shard", shards),
]

#: Not expressible in SQL: two stages learn or estimate from the texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
