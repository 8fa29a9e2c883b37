"""Exactly-once upserts: replays, failures before and after the ledger, watermarks, compaction."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.sources import files, pages
from siltstone.streaming import ingestion

SCHEMA = "key bigint, value string"
order = lambda: F.col("n")
content = lambda: F.coalesce("value", F.lit("null"))


@pytest.fixture
def store(spark, tmp_path):
    return ingestion.Store(spark, f"file://{tmp_path}/store", "key", SCHEMA)


def batch(spark, *rows):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], SCHEMA + ", n int")


def held(store):
    return sorted((r["key"], r["value"], r["version"]) for r in store.current().collect())


def put(store, spark, name, *rows):
    return store.upsert(batch(spark, *rows), name, order(), content())


def test_outcomes_and_replays(spark, store):
    assert held(store) == []
    first = put(store, spark, "b0", (1, "a"), (2, "b"), (1, "c"), (None, "x"))
    assert first == {"INSERTED": 2, "UPDATED": 0, "UNCHANGED": 0}
    assert put(store, spark, "b1", (1, "c"), (2, "z"), (3, None)) == {"INSERTED": 1, "UPDATED": 1, "UNCHANGED": 1}
    want = [(1, "c", 1), (2, "z", 2), (3, None, 1)]
    assert held(store) == want
    assert put(store, spark, "b0", (9, "other rows under a known name")) == first
    assert held(store) == want
    assert put(store, spark, "b2", (1, "c")) == {"INSERTED": 0, "UPDATED": 0, "UNCHANGED": 1} and held(store) == want


def test_a_batch_that_dies_before_its_entry_changes_nothing(spark, store, monkeypatch):
    put(store, spark, "b0", (1, "a"))

    def die(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingestion, "put_new", die)
        with pytest.raises(OSError):
            put(store, spark, "b1", (1, "b"), (2, "c"))
    assert held(store) == [(1, "a", 1)] and not store.finish(10, ["b0", "b1"]) and store.watermark() == 0
    assert store.sweep() == ["b1"]
    put(store, spark, "b1", (1, "b"), (2, "c"))
    assert held(store) == [(1, "b", 2), (2, "c", 1)]
    assert store.finish(10, ["b0", "b1"]) and store.watermark() == 10 and store.window(200_000, 4) == (6, 200_000)
    assert not store.finish(10, ["b0"])


def test_compaction_keeps_versions(spark, store):
    for i in range(4):
        put(store, spark, f"b{i}", (1, f"v{i}"), (i + 10, "x"))
    want = held(store)
    store.compact("c0")
    assert held(store) == want and store.sweep() == ["b0", "b1", "b2", "b3"] and held(store) == want
    put(store, spark, "b4", (1, "last"))
    assert held(store)[0] == (1, "last", 5)


def save(root, page, items, more):
    (root / f"{page}.json").write_text(json.dumps({"items": [{"key": k, "value": v} for k, v in items], "has_more": more}))


def test_a_run_that_fails_moves_no_watermark_and_goes_on(spark, store, tmp_path):
    source = pages.register(spark)
    for p in range(1, 4):
        save(tmp_path, p, [(10 * p + i, "v") for i in range(3)], p < 3)
    stream = lambda: spark.readStream.format(source).option("url", f"{tmp_path}/{{page}}.json").option("spool", f"file://{tmp_path}/spool").option("pages_per_batch", 1).load()
    calls = []

    def parse(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("worker lost")
        return df.select(F.from_json("body", SCHEMA).alias("i"), (F.col("page") * 1000 + F.col("item")).alias("n")).select("i.*", "n")

    go = lambda: ingestion.run(store, stream(), parse, f"{tmp_path}/checkpoint", "r", 77, content(), order())
    with pytest.raises(Exception, match="worker lost"):
        go()
    assert store.watermark() == 0 and 0 < len(held(store)) < 9
    go()
    assert store.watermark() == 77 and held(store) == [(10 * p + i, "v", 1) for p in (1, 2, 3) for i in range(3)]


def test_of_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/x/pointer.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.put_new(spark, path, str(i)), range(8)))
    assert sum(won) == 1 and files.get(spark, path) == str(won.index(True))
    assert files.names(spark, f"file://{tmp_path}/x") == ["pointer.json"] and files.get(spark, f"file://{tmp_path}/y") is None
