"""The queries by name, each with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder; each attribute reads one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables by name."""
        for name in NAMES:
            if re.search(rf"\b{name}\b", text):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def sql_query(name: str, text: str) -> None:
    """A query whose text both Spark and DuckDB read."""
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
    ORACLE_SQL[name] = text


def query(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
