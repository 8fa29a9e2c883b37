"""Exactly-once upserts of a stream of pages, and a watermark that moves only when a run is whole.

A batch writes its new and changed rows into a folder of its own and then puts its entry into the
ledger.  Readers see the folders that the ledger names, so a batch that dies before its entry
changes nothing, and one that comes again finds its entry and changes nothing either.  A run
reads a window of time that is fixed when it begins; only when all its batches are in the ledger
is the window's end written down as the new watermark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.files import get, names, put_new, remove

#: Rows are laid out by so many hash ranges of their key, so that a small batch reads few of them.
BUCKETS = 64
OUTCOMES = ("INSERTED", "UPDATED", "UNCHANGED")


@dataclass
class Store:
    """The rows of one source: ``key`` names them, ``hash`` says whether they changed.

    Versions count from 1 and rise with each change.  Null keys are refused.
    """

    spark: SparkSession
    root: str
    key: str
    schema: str

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _folder(self, batch: str) -> str:
        return f"{self.root}/data/batch={batch}"

    def _entries(self) -> dict[str, dict]:
        return {n[:-5]: json.loads(get(self.spark, f"{self.root}/ledger/{n}")) for n in names(self.spark, f"{self.root}/ledger")}

    def entry(self, batch: str) -> dict | None:
        found = get(self.spark, f"{self.root}/ledger/{batch}.json")
        return None if found is None else json.loads(found)

    def _written(self, buckets: list[int] | None = None) -> DataFrame:
        """All versions of rows in folders that the ledger names and no later compaction has taken up."""
        entries = self._entries()
        gone = {b for e in entries.values() for b in e.get("replaces", ())}
        folders = [self._folder(b) for b in entries if b not in gone and entries[b]["folder"]]
        schema = f"{self.schema}, content_hash string, version bigint, bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*folders).drop("batch")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """The last version of every row."""
        rows = self._written(buckets)
        packed = F.struct(*(c for c in rows.columns if c != self.key))
        return rows.groupBy(self.key).agg(F.max_by(packed, "version").alias("r")).select(self.key, "r.*").drop("bucket")

    def upsert(self, rows: DataFrame, batch: str, order: Column, content: Column) -> dict[str, int]:
        """Brings rows into the store under the batch's name and returns the outcomes' numbers.

        Of several rows with one key the last by ``order`` counts.  A batch that the ledger knows
        changes nothing and returns what it did the first time.
        """
        if (known := self.entry(batch)) is not None:
            return known["counts"]
        columns = self._columns()
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(BUCKETS)).cast("int")
        last = rows.select(*columns, order.alias("__order"), F.sha2(content, 256).alias("content_hash")).where(F.col(self.key).isNotNull())
        last = last.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in last.columns if c not in (self.key, "__order"))), "__order").alias("r")).select(self.key, "r.*").withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = self._written(touched).groupBy(self.key).agg(F.max_by("content_hash", "version").alias("__hash"), F.max("version").alias("__version"))
        both = last.join(stored, self.key, "left")
        outcome = F.when(F.col("__hash").isNull(), "INSERTED").when(F.col("__hash") != F.col("content_hash"), "UPDATED").otherwise("UNCHANGED")
        seen = Observation()
        judged = both.withColumn("__outcome", outcome).observe(seen, F.count(F.lit(1)).alias("READ"), *(F.count(F.when(F.col("__outcome") == o, 1)).alias(o) for o in OUTCOMES))
        changed = judged.where("__outcome <> 'UNCHANGED'").select(*columns, "content_hash", (F.coalesce("__version", F.lit(0)) + 1).cast("long").alias("version"), "bucket")
        try:
            changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(batch))
        finally:
            last.unpersist()
        counts = {o: int(seen.get[o]) for o in OUTCOMES}
        entry = {"counts": counts, "folder": counts["INSERTED"] + counts["UPDATED"] > 0}
        put_new(self.spark, f"{self.root}/ledger/{batch}.json", json.dumps(entry))
        return self.entry(batch)["counts"]

    def compact(self, name: str) -> None:
        """Puts the last versions of all batches so far into one folder, which takes their place at once."""
        entries = self._entries()
        rows = self._written()
        packed = F.struct(*(c for c in rows.columns if c != self.key))
        last = rows.groupBy(self.key).agg(F.max_by(packed, "version").alias("r")).select(self.key, "r.*")
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(name))
        put_new(self.spark, f"{self.root}/ledger/{name}.json", json.dumps({"counts": dict.fromkeys(OUTCOMES, 0), "folder": bool(entries), "replaces": sorted(entries)}))

    def sweep(self) -> list[str]:
        """Removes folders of dead batches and of those that a compaction replaced; returns their names."""
        entries = self._entries()
        gone = {b for e in entries.values() for b in e.get("replaces", ())}
        written = [n.removeprefix("batch=") for n in names(self.spark, f"{self.root}/data")]
        dead = [b for b in written if b not in entries or b in gone]
        for b in dead:
            remove(self.spark, self._folder(b))
        return dead

    def watermark(self) -> int:
        """The end of the last window that was read to its end; 0 before the first."""
        return max((int(n[:-5]) for n in names(self.spark, f"{self.root}/runs")), default=0)

    def window(self, now: int, overlap: int = 86_400) -> tuple[int, int]:
        """The times that a run reads: from the watermark, less an overlap for late edits, to now."""
        return max(0, self.watermark() - overlap), now

    def finish(self, todate: int, batches: list[str]) -> bool:
        """Moves the watermark to the end of a window whose batches are all in the ledger."""
        if any(self.entry(b) is None for b in batches):
            return False
        return put_new(self.spark, f"{self.root}/runs/{todate:020d}.json", json.dumps({"batches": batches}))


def run(store: Store, stream: DataFrame, parse, checkpoint: str, name: str, todate: int, content: Column, order: Column) -> dict[str, int]:
    """Reads a stream to its end into the store, batch by batch, and then moves the watermark.

    ``parse`` makes the store's columns from a batch of the stream.  A run that fails may be run again
    with the same name and checkpoint: it goes on with the batch that failed.
    """
    totals, done = dict.fromkeys(OUTCOMES, 0), []

    def sink(batch: DataFrame, number: int) -> None:
        counts = store.upsert(parse(batch), f"{name}-{number:09d}", order, content)
        done.append(f"{name}-{number:09d}")
        for o in OUTCOMES:
            totals[o] += counts[o]

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    store.finish(todate, done)
    return totals
