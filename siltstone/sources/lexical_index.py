"""A lexical index that is kept up by signed deltas.

Each batch of upserts and deletes writes the postings that go (sign -1) and those that come (+1),
and what they change in each term's document frequency and in the corpus size and length; its
entry in the ledger makes all of it visible at once.  Sums over the deltas are the index, so
it equals one that is built anew.  A document's own terms are kept beside its size, so that
what goes is known without its old text.

Terms are counted within a text's row.  Postings are laid down as blocks: a term with the keys,
counts and sizes of the documents of one Arrow batch that have it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.operators.retrieval import TEXT_BLOCK
from siltstone.sources.files import get, names, put_new

#: Postings are laid out by so many hash ranges of their term; an index keeps its number.
BUCKETS = 64
_DOCS = "key bigint, dl bigint, counts map<string,int>, hash string"
_BLOCKS = "term string, n bigint, keys array<bigint>, tfs array<int>, dls array<bigint>"
_POSTINGS = f"{_BLOCKS}, sign int, bucket int"
_STATS = "term string, df bigint, bucket int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_DOCS of key, hash and words."""
    for batch in batches:
        for i in range(0, len(batch), TEXT_BLOCK):
            part = batch.slice(i, TEXT_BLOCK)
            size, known = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), part.column(2).flatten().dictionary_encode()
            most = max(1, len(known.dictionary))
            cell, n = np.unique(np.repeat(np.arange(len(part)), size) * most + known.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, term = np.divmod(cell, most)
            ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
            counts = pa.MapArray.from_arrays(ends, known.dictionary.take(pa.array(term)), pa.array(n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), counts, part.column(1)], ["key", "dl", "counts", "hash"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_BLOCKS of key, dl and each document's terms and counts."""
    for batch in batches:
        size, known = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().dictionary_encode()
        term = known.indices.to_numpy(zero_copy_only=False)
        order, most = np.argsort(term, kind="stable"), len(known.dictionary)
        row, ends = np.repeat(np.arange(len(batch)), size)[order], np.searchsorted(term[order], np.arange(most + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (batch.column(0).take(pa.array(row)), batch.column(3).flatten().take(pa.array(order)), batch.column(1).take(pa.array(row)))]
        yield pa.RecordBatch.from_arrays([known.dictionary, pa.array(np.diff(ends)), *lists], ["term", "n", "keys", "tfs", "dls"])


def _each() -> Column:
    """key, tf, dl of each document of a block."""
    return F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))


def _few(ids: DataFrame) -> DataFrame:
    """ids, sent to the tasks if they are few."""
    return F.broadcast(ids) if ids.limit(retrieval.MOST_IDS + 1).count() <= retrieval.MOST_IDS else ids


@dataclass
class LexicalIndex:
    spark: SparkSession
    root: str
    analyzer: Callable[[Column], Column] = retrieval.terms
    buckets: int = BUCKETS

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("bucket")

    def _entries(self) -> dict[int, dict]:
        return {int(n[:-5]): json.loads(get(self.spark, f"{self.root}/ledger/{n}")) for n in names(self.spark, f"{self.root}/ledger")}

    def _read(self, kind: str, schema: str, entries: dict[int, dict] | None = None) -> DataFrame:
        """The rows of a kind in all batches of the ledger since the last compaction."""
        entries = self._entries() if entries is None else entries
        start = max((b for b, e in entries.items() if e.get("compacted")), default=0)
        folders = [f"{self.root}/{kind}/batch={b}" for b in sorted(entries) if b >= start]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{self.root}/{kind}").parquet(*folders)

    def documents(self) -> DataFrame:
        """key, dl, counts, hash of the documents that are there."""
        rows = self._read("documents", _DOCS)
        last = rows.groupBy("key").agg(F.max_by(F.struct("dl", "counts", "hash"), "batch").alias("r"))
        return last.select("key", "r.*").where("counts IS NOT NULL")

    def update(self, batch: int, upserts: DataFrame, deletes: DataFrame | None = None) -> bool:
        """Applies upserts (key, text) and deletes (key) under a batch number above all earlier ones.

        A number that the ledger knows changes nothing; a batch that dies before its entry is not
        seen.  One key comes once; a key in both is deleted.  Unchanged texts write nothing.
        """
        entries = self._entries()
        if batch in entries:
            return False
        if batch <= max(entries, default=0):
            raise ValueError(f"batch {batch} comes after {max(entries)}")
        words = F.coalesce(self.analyzer(F.col("text")), F.array().cast("array<string>"))
        fresh = upserts.where("key IS NOT NULL").select(F.col("key").cast("bigint").alias("key"), words.alias("words"))
        gone = None if deletes is None else deletes.where("key IS NOT NULL").select(F.col("key").cast("bigint").alias("key")).distinct()
        if gone is not None:
            fresh = fresh.join(_few(gone), "key", "left_anti")
        rows = fresh.select("key", F.sha2(F.array_join("words", "\0"), 256).alias("hash"), "words").mapInArrow(_counted, _DOCS)
        if gone is not None and entries:
            rows = rows.unionByName(gone, allowMissingColumns=True)
        if entries:  # a deleted key has no hash, and neither has one that was not there
            last = self._read("documents", _DOCS, entries).groupBy("key").agg(F.max_by(F.struct("hash", "dl", "batch"), "batch").alias("r")).where("r.hash IS NOT NULL")
            rows = rows.join(last.select("key", F.col("r.hash").alias("old_hash")), "key", "left").where("NOT (hash <=> old_hash)").drop("old_hash")
        rows.write.mode("overwrite").parquet(f"{self.root}/documents/batch={batch}")
        new = self._read("documents", _DOCS, {batch: {}})
        here = new.where("hash IS NOT NULL")
        blocks, sizes = self._blocks(here, 1), here.select("dl", F.lit(1).alias("sign"))
        if entries:
            folder = f"{self.root}/changes/batch={batch}"
            last.join(_few(new.select("key")), "key", "left_semi").select("key", "r.dl", "r.batch").write.mode("overwrite").parquet(folder)
            old = self.spark.read.schema("key bigint, dl bigint, batch bigint").parquet(folder)
            replaced = self._read("documents", _DOCS, entries).join(_few(old.select("key", "batch")), ["key", "batch"], "left_semi")
            blocks, sizes = blocks.unionByName(self._blocks(replaced, -1)), sizes.unionByName(old.select("dl", F.lit(-1).alias("sign")))
        self._write("postings", batch, blocks)
        delta = self._read("postings", _POSTINGS, {batch: {}}).groupBy("term").agg(F.sum(F.col("sign") * F.col("n")).alias("df")).where("df <> 0")
        self._write("stats", batch, delta.select("term", "df", self._bucket("term")))
        n, length = sizes.agg(F.coalesce(F.sum("sign"), F.lit(0)), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0))).first()
        return put_new(self.spark, f"{self.root}/ledger/{batch:012d}.json", json.dumps({"n": int(n), "length": int(length)}))

    def _blocks(self, documents: DataFrame, sign: int) -> DataFrame:
        """_POSTINGS of documents (key, dl, counts)."""
        rows = documents.select("key", "dl", F.map_keys("counts").alias("terms"), F.map_values("counts").alias("tfs")).mapInArrow(_blocked, _BLOCKS)
        return rows.select("*", F.lit(sign).alias("sign"), self._bucket("term"))

    def _write(self, kind: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/batch={batch}")

    def size(self) -> tuple[int, float]:
        """Number and average length of documents."""
        entries = self._entries()
        start = max((b for b, e in entries.items() if e.get("compacted")), default=0)
        n, length = (sum(e[f] for b, e in entries.items() if b >= start) for f in ("n", "length"))
        return n, length / n if n else 0.0

    def frequencies(self, buckets: list[int] | None = None) -> DataFrame:
        """term and df of terms that some document has."""
        rows = self._read("stats", _STATS)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """term, key, tf, dl of the documents that are there."""
        rows = self._read("postings", _POSTINGS)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        rows = rows.select("term", "sign", _each())
        sums = rows.groupBy("term", "key").agg(F.sum("sign").alias("here"), *(F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("tf", "dl")))
        return sums.where("here > 0").drop("here")

    def search(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        """query, key, score, rank of the k best documents, as bm25() gives them; only buckets of asked terms are read."""
        asked = queries.select(F.col(query).cast("bigint").alias(query), F.explode(F.array_distinct(self.analyzer(F.col(text)))).alias("term"))
        n, avgdl = self.size()
        out = None
        for block in retrieval.blocks_asked(asked, query):
            places = F.broadcast(self.spark.createDataFrame(list(enumerate(block.terms)), "place int, term string"))
            buckets = [r["bucket"] for r in places.select(self._bucket("term")).distinct().collect()]  # ``buckets`` at most
            df = {r["place"]: r["df"] for r in self.frequencies(buckets).join(places, "term").collect()}  # a row an asked term
            found = self._by_key(buckets, places)
            best = retrieval.best_of(found, block, df, n, avgdl, query, "key", k)
            out = best if out is None else out.unionByName(best)
        return out

    def _by_key(self, buckets: list[int], places: DataFrame) -> DataFrame:
        """A row of each document that is there with the counts of some terms (term, place), after one shuffle by key."""
        rows = self._read("postings", _POSTINGS).where(F.col("bucket").isin(buckets)).join(places, "term").select("place", "sign", _each()).repartition("key")
        sums = rows.groupBy("key", "place").agg(F.sum("sign").alias("here"), *(F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("tf", "dl"))).where("here > 0")
        return sums.groupBy("key").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("place", F.col("tf").cast("double").alias("tf"))).alias("x")).select("key", "dl", F.col("x.place").alias("terms"), F.col("x.tf").alias("counts"))

    def compact(self, batch: int) -> bool:
        """Writes the sums of all deltas as one batch, from which reading then starts."""
        if batch <= max(self._entries(), default=0):
            raise ValueError("a compaction needs a number above all batches")
        n, avgdl = self.size()
        self.documents().select("key", "dl", "counts", "hash").write.mode("overwrite").parquet(f"{self.root}/documents/batch={batch}")
        self._write("postings", batch, self._blocks(self._read("documents", _DOCS, {batch: {}}), 1))
        self._write("stats", batch, self.frequencies().select("term", "df", self._bucket("term")))
        return put_new(self.spark, f"{self.root}/ledger/{batch:012d}.json", json.dumps({"n": n, "length": round(n * avgdl), "compacted": True}))
