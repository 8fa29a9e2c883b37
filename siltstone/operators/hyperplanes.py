"""Approximate cosine search by random hyperplanes, with exact scores at the end.

Each of several tables hashes a vector to the signs of its products with random directions.  A query
looks into the bucket of its own signs and into those that it reaches by crossing a few directions
that it lies near to; what crossing costs is the sum of the squared products.  How many bits
a table has, and how far a query reaches, is fitted when the index is built: exact neighbours of
a bounded sample of vectors show which of them a setting would find.  What a query finds is scored
exactly.  Equal vectors are indexed once, with as many of their keys as can be asked for.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import cosine, top_k
from siltstone.sources.shared import new_folder

TABLES = 8
#: At least about so many different vectors share a bucket.
BUCKET_SIZE = 16
#: A query crosses at most so many of the nearest directions of a table, out of so many.
FLIPS, NEAREST = 4, 12
#: The share of the sample's neighbours that has to be found, and the sample's size in vectors.
TARGET, SAMPLE = 0.94, 64
SEED = 20240607
MOST_BITS = 40
#: The keys of one vector are ranked in so many parts before they are merged.
SALTS = 64
#: Probes up to this many rows are broadcast.
BROADCAST_PROBES = 1_000_000


def _planes(tables: int, bits: int, size: int) -> np.ndarray:
    """Directions as (table, bit, coordinate); fewer bits are the first ones of more."""
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((MOST_BITS, tables, size))[:bits].swapaxes(0, 1).reshape(tables * bits, size)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _products(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Products of vectors, brought to length 1, with the directions, as (vector, table, bit)."""
    x = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    return (x @ _planes(tables, bits, x.shape[1]).T).reshape(len(x), tables, bits)


@dataclass
class HyperplaneIndex:
    """``vectors`` (id, embedding, keys) holds different vectors, ``buckets`` (table, code, id) where they are, ``sizes`` (table, code, n) how many."""

    vectors: DataFrame
    buckets: DataFrame
    sizes: DataFrame
    tables: int
    bits: int
    reach: float
    keys: int


def build(spark: SparkSession, vectors: DataFrame, key: str, k: int, tables: int = TABLES) -> HyperplaneIndex:
    """An index of vectors (key, embedding) for up to k results; null vectors and those without length are left out."""
    root = new_folder(spark, "hyperplanes")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    rows = vectors.where(F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & (length > 0)).select(F.col(key).cast("bigint").alias("key"), "embedding")
    part = Window.partitionBy("embedding", "salt").orderBy("key")
    least = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= k)
    merged = least.groupBy("embedding").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k).alias("keys"))  # k * SALTS keys at most
    merged.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{root}/vectors")
    distinct = spark.read.parquet(f"{root}/vectors")
    bits, reach = fitted(distinct, k, tables)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if len(batch):
                code = (_products(_matrix(batch.column("embedding")), tables, bits) > 0) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(batch))), pa.array(code.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), tables))], ["table", "code", "id"])

    distinct.select("id", "embedding").mapInArrow(codes, "table int, code bigint, id bigint").write.partitionBy("table").parquet(f"{root}/buckets")
    buckets = spark.read.schema("code bigint, id bigint, table int").parquet(f"{root}/buckets")
    buckets.groupBy("table", "code").agg(F.count("*").alias("n")).write.parquet(f"{root}/sizes")
    return HyperplaneIndex(distinct, buckets, spark.read.parquet(f"{root}/sizes"), tables, bits, reach, k)


def fitted(distinct: DataFrame, k: int, tables: int) -> tuple[int, float]:
    """The most bits, and the least reach, with which the sample's exact neighbours are found.

    The sample is SAMPLE vectors by hash; its neighbours come from one exact pass over all vectors, and SAMPLE * k
    of them at most come to the driver.  With few bits every bucket is in reach, so the target is always met.
    """
    if not (n := distinct.count()):
        return 1, math.inf
    most = min(MOST_BITS, max(1, math.ceil(math.log2(max(n, 2) / BUCKET_SIZE))))
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("id").alias("query"), F.col("embedding").alias("asked"))
    pairs = cosine(distinct.select("id", "embedding"), sample, "id", "query", k).join(sample, "query").join(distinct, "id").select("asked", "embedding").toArrow()
    asked, there = (_products(_matrix(pairs[c].combine_chunks()), tables, most) for c in ("asked", "embedding"))
    for bits in range(most, 0, -1):
        mine, other = asked[:, :, :bits], there[:, :, :bits]
        crossed = (mine > 0) != (other > 0)
        rank = np.argsort(np.argsort(np.abs(mine), axis=2), axis=2)
        allowed = (crossed.sum(axis=2) <= FLIPS) & ~(crossed & (rank >= NEAREST)).any(axis=2)
        cost = np.where(allowed, (crossed * mine**2).sum(axis=2), np.inf).min(axis=1)
        reach = float(np.sort(cost)[math.ceil(TARGET * len(cost)) - 1])
        if reach < math.inf:
            break
    return bits, reach


def probes(queries: DataFrame, query: str, tables: int, bits: int, reach: float) -> DataFrame:
    """query, table, code of the buckets within the reach of each query (``asked``), its own first."""
    near = min(bits, NEAREST)
    subsets = [s for r in range(min(FLIPS, near) + 1) for s in itertools.combinations(range(near), r)]
    chosen = np.zeros((len(subsets), near))
    for i, s in enumerate(subsets):
        chosen[i, list(s)] = 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            products = _products(_matrix(batch.column("asked")), tables, bits)
            own = (products > 0) @ weights
            order = np.argsort(np.abs(products), axis=2)[:, :, :near]
            cost = np.take_along_axis(products, order, 2) ** 2 @ chosen.T
            code = own[:, :, None] ^ (weights[order] @ chosen.T.astype(np.int64))
            row, table, i = np.nonzero(cost <= reach * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(query).take(pa.array(row)), pa.array(table.astype(np.int32)), pa.array(code[row, table, i])], [query, "table", "code"])

    return queries.mapInArrow(look, f"{query} bigint, table int, code bigint")


def search(index: HyperplaneIndex, queries: DataFrame, query: str, k: int) -> DataFrame:
    """query, key, score, rank of about the k nearest vectors of each query (``asked``), however many lie in reach; scores are exact, ties go to the smaller key.

    Queries without length find nothing.
    """
    if k > index.keys:
        raise ValueError(f"the index was built for {index.keys} results")
    length = F.aggregate("asked", F.lit(0.0), lambda s, x: s + F.abs(x))
    asked = queries.where(F.col("asked").isNotNull()).where((F.size("asked") > 0) & (length > 0)).select(F.col(query).cast("bigint").alias(query), "asked")
    # buckets that hold something
    looked = probes(asked, query, index.tables, index.bits, index.reach).join(index.sizes, ["table", "code"]).select(query, "table", "code")
    path = new_folder(asked.sparkSession, "probes")
    looked.write.parquet(path)
    looked = asked.sparkSession.read.parquet(path)
    if looked.count() <= BROADCAST_PROBES:
        looked = F.broadcast(looked)
    found = index.buckets.join(looked, ["table", "code"]).select(query, "id").distinct()
    pairs = found.join(index.vectors, "id").join(asked, query)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.round(product("embedding", "asked") / F.sqrt(product("embedding", "embedding")) / F.sqrt(product("asked", "asked")), 6)
    best = top_k(pairs.select(query, "id", score.alias("score"), F.col("keys")[0].alias("key"), "keys"), query, "key", "score", k)
    return top_k(best.select(query, "score", F.explode("keys").alias("key")), query, "key", "score", k)
