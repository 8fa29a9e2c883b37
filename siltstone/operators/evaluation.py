"""Ranking and answer-quality measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are cut into.
PARTS = 64


def ranking_measures(ranked: DataFrame, relevant: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """recall, hit, mrr and ndcg at k for each query of ``relevant`` (query, key; key null: nothing is).

    A query without relevant documents measures 0.
    """
    wanted = relevant.groupBy(query).agg(F.count(key).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, [query, key]).groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = wanted.join(hits, query, "left").fillna({"hits": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    some = F.col("n") > 0
    return rows.select(
        query,
        F.when(some, F.round(F.col("hits") / F.col("n"), 6)).otherwise(0.0).alias("recall"),
        (F.col("hits") > 0).cast("bigint").alias("hit"),
        F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"),
        F.when(some, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"),
    )


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """The index, from 0, of the ceil(p n)-th smallest of n values."""
    return lambda n: F.greatest(F.ceil(F.lit(p) * n), F.lit(1)) - 1


def rounded_index(p: float) -> Callable[[Column], Column]:
    """The index (n - 1) p, rounded half to even."""
    return lambda n: F.bround((n - 1) * p)


def quantiles(rows: DataFrame, group: str, value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group and, under each name of ``wanted``, the exact value at an index (from 0) of its sorted values; nulls don't count.

    Approximate quantiles cut a group's values into PARTS ranges, equal values are counted first, and
    each range is sorted on its own, so that no task sorts a whole group.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, value)
    cuts = known.groupBy(group).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 10_000).alias("cuts"), F.count("*").alias("n"))
    counts = known.groupBy(group, value).agg(F.count("*").alias("c")).join(cuts, group)
    counts = counts.withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(group, "part").agg(F.sum("c").alias("z")).withColumn("before", F.coalesce(F.sum("z").over(ahead), F.lit(0))).drop("z")
    inside = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("here", F.sum("c").over(inside)).join(parts, [group, "part"])
    upto = F.col("before") + F.col("here")
    return placed.groupBy(group).agg(*(F.min(F.when(upto > index(F.col("n")), F.col(value))).alias(name) for name, index in wanted.items()))
