"""Recall of the hyperplane index against exact search, and its odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import hyperplanes, retrieval
from siltstone.plans import registry

SCHEMA = "key bigint, embedding array<float>"


def found(df, query="item_id", key="doc_id"):
    return {(r[query], r[key]): (r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_at_60(spark, sf):
    exact = found(registry.QUERIES["dense_topk"](spark, f"/root/testdata/{sf}"))
    near = found(registry.QUERIES["dense_topk_hyperplanes"](spark, f"/root/testdata/{sf}"))
    hits = exact.keys() & near.keys()
    assert len(hits) / len(exact) >= 0.9
    assert all(abs(exact[p][0] - near[p][0]) < 2e-6 for p in hits) and len(near) == len(exact)


def test_clusters_are_found_in_few_buckets(spark):
    """Well separated clusters: nearly all neighbours, and a small part of the vectors is looked at."""
    rng = np.random.default_rng(23)
    centres = rng.standard_normal((60, 32))
    rows = [(i, [float(v) for v in centres[i % 60] + 0.25 * rng.standard_normal(32)]) for i in range(6_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = hyperplanes.build(spark, df, "key", 20)
    asked = df.where("key % 100 = 0").select(F.col("key").alias("query"), F.col("embedding").alias("asked"))
    exact = found(retrieval.cosine(df, asked, "key", "query", 20), "query", "key")
    near = found(hyperplanes.search(index, asked, "query", 20), "query", "key")
    assert len(exact.keys() & near.keys()) / len(exact) >= 0.9
    looked = hyperplanes.probes(asked, "query", index.tables, index.bits, index.reach).join(index.buckets, ["table", "code"]).select("query", "id").distinct().count()
    assert index.bits >= 5 and looked < 0.25 * 60 * 6_000


def test_equal_and_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(200)] + [(1000, [-1.0, 0.0, 1.0]), (1001, None), (1002, [0.0, 0.0, 0.0]), (1003, [2.0, 4.0, 6.0]), (1004, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = hyperplanes.build(spark, df, "key", 5)
    assert index.vectors.count() == 3
    asked = spark.createDataFrame([(1, same), (2, None), (3, [0.0, 0.0, 0.0])], "query bigint, asked array<float>")
    got = hyperplanes.search(index, asked, "query", 5).orderBy("rank").collect()
    assert [(r["query"], r["key"], r["score"]) for r in got] == [(1, k, 1.0) for k in range(5)]
    with pytest.raises(ValueError):
        hyperplanes.search(index, asked, "query", 6)
    empty = hyperplanes.build(spark, df.limit(0), "key", 5)
    assert hyperplanes.search(empty, asked, "query", 5).count() == 0
