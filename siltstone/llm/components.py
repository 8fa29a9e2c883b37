"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); component is the smallest id that it reaches.

    Alternating large-star and small-star rounds: each takes every node's smallest neighbour by
    a partial aggregate and hands it to the other neighbours by a join that Spark may split when
    one node has very many.  Each round is written to the shared folder, which cuts its lineage.
    The rounds end when one changes nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    last, turn = None, 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        state = Observation()
        seen = small.distinct().observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        after = scratch.keep(f"{name}-{turn}", seen)
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
        now = after
        if state.get == last:
            break
        last = state.get
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
