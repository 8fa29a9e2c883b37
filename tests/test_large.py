"""Queries that once did work that grew faster than their tables."""

import json

import duckdb
import pytest

import siltstone.plans  # noqa: F401
from siltstone.plans import registry


@pytest.mark.parametrize("orders", [[1, 2, 3, None]])
@pytest.mark.parametrize("lines", [[(1, "F"), (1, "F"), (2, "O")], [(1, "F"), (None, "F")], [(1, "O"), (None, "O")]])
def test_documents_without_index_meets_by_key(spark, tmp_path, orders, lines):
    spark.createDataFrame([(k, "P" if k == 3 else "O") for k in orders], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["documents_without_index"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL["documents_without_index"]).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert "ExistenceJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_bm25_keeps_only_the_best_before_it_shuffles(spark, tmp_path):
    """Pairs of queries and documents stay in their tasks; keys that come twice and null keys are as in SQL."""
    words = ["red", "fox", "dog", "Blue", "and", "x1"]
    docs = [(i, " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 9))) for i in range(300)] + [(7, "red red dog"), (8, ""), (None, "red fox"), (None, "blue")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red fox"), (2, "DOG"), (3, "nothing"), (4, ""), (5, "and x1 blue and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = registry.QUERIES["bm25_topk"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(registry.ORACLE_SQL["bm25_topk"]).fetchall())
    once = registry.QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()


def test_texts_that_contain_items_stay_in_their_tasks(spark, tmp_path):
    """Repeated ids, null ids, short items and items that begin or end within a word are as in SQL, and no text is shuffled."""
    from siltstone.operators import retrieval

    docs = [(1, "a red fox runs home"), (2, "the hundred foxes run red"), (2, "RED fox runs"), (3, "dog, red fox runs; red fox runs"), (3, "a red fox runs"), (4, None), (5, ""), (None, "red fox runs"), (6, "fox red runs")]
    items = [(1, "red fox runs"), (2, "red fox"), (3, "ed fox run"), (4, "dog, red fox runs; red"), (5, ""), (6, None), (7, "none of these at all"), (1, "fox"), (None, "red"), (8, "dog"), (9, ", ")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    df = retrieval.containing(read("documents"), read("benchmark"), "doc_id", "text", "item_id", "text")
    want = con.execute("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len(want) > 20
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = registry.QUERIES["ranking_measures_at_10"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(registry.ORACLE_SQL["ranking_measures_at_10"]).fetchall()))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_found_documents_are_shuffled(spark, monkeypatch, most):
    """The ids of lists go to the documents; too many of them still meet their documents."""
    from siltstone.operators import retrieval

    monkeypatch.setattr(retrieval, "MOST_IDS", most)
    docs = spark.range(1_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text").union(spark.sql("SELECT 5, 'again' UNION ALL SELECT null, 'none'"))
    rows = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (2, 5_000), (3, None)], "item_id long, doc_id long")
    df = retrieval.documents_of(rows, docs, "doc_id", "left")
    assert sorted(map(str, df.select("item_id", "doc_id", "text").collect())) == sorted(map(str, rows.join(docs, "doc_id", "left").select("item_id", "doc_id", "text").collect()))
    assert ("LeftSemi" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0)


def test_lists_send_their_ids_to_the_documents(spark):
    for name in ("source_projection", "hydrate_visible", "hybrid_rrf"):
        assert "LeftSemi" in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_saved_pages_make_chains_of_bounded_length(spark, tmp_path):
    """Batches take some pages of every chain, so longer chains would mean more batches, and pages beyond max_pages would be lost."""
    from pyspark.sql import functions as F

    from siltstone.sources import pages

    items = spark.range(600).select("id", F.to_json(F.struct("id")).alias("body"))
    urls = pages.save_pages(items, ["id"], F.col("body"), f"file://{tmp_path}/pages", 2).split()
    assert len(urls) == 600 // 2 // pages.CHAIN_PAGES
    rows = spark.read.format(pages.register(spark)).option("url", " ".join(urls)).load()
    assert rows.agg(F.max("page")).first()[0] <= 2 * pages.CHAIN_PAGES
    assert sorted(json.loads(r["body"])["id"] for r in rows.collect()) == list(range(600))


class Calls(dict):
    """A processor's state without Spark: values and maps that count how often they are asked."""

    def __init__(self):
        super().__init__()
        self.n = 0

    def getValueState(self, name, *schema):
        return Kept(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.n += 1
        self["timer"] = at


class Kept:
    def __init__(self, calls, name):
        self.calls, self.held = calls, calls.setdefault(name, {})

    def _do(self, value=None):
        self.calls.n += 1
        return value

    def get(self):
        return self._do(self.held.get(None))

    def exists(self):
        return self._do(bool(self.held))

    def update(self, value):
        self.held[None] = self._do(value)

    def clear(self):
        self._do(self.held.clear())

    def containsKey(self, key):
        return self._do(key in self.held)

    def getValue(self, key):
        return self._do(self.held[key])

    def updateValue(self, key, value):
        self.held[key] = self._do(value)

    def removeKey(self, key):
        del self.held[self._do(key)]

    def keys(self):
        return self._do(iter(list(self.held)))


@pytest.mark.parametrize("near", [0, 5, 1_000])
def test_rows_of_a_small_key_wait_beside_its_state(near):
    """A batch costs a small key three calls, whatever its rows' times; a larger key's rows wait in slots and come out alike."""
    import pandas as pd

    from siltstone.streaming import events

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    hour, told, costs, clock, calls = 3_600_000_000, [], [], Clock(), Calls()
    limit = events.RateLimit(2, 4 * 3_600)
    limit.near = near
    limit.init(calls)
    for batch in (range(0, 40), range(20, 60)):
        before = calls.n
        assert not list(limit.handleInputRows((7,), iter([pd.DataFrame({"us": [(i * 37 % 60) * hour + i for i in batch], "event_id": list(batch)})]), clock))
        costs.append(calls.n - before)
    for clock.now in (10 * hour // 1_000, 33 * hour // 1_000 + 1, 100 * hour // 1_000):
        told += [tuple(r) for frame in limit.handleExpiredTimer((7,), clock, None) for r in frame.itertuples(index=False)]
    rows, recent, want = sorted(((i * 37 % 60) * hour + i, i) for batch in (range(0, 40), range(20, 60)) for i in batch), [], []
    for at, i in rows:
        recent = [x for x in recent if x > at - 4 * hour]
        want.append((7, i, len(recent) < 2))
        if want[-1][2]:
            recent.append(at)
    assert told == want and not calls["pending"] and not calls["state"]
    assert near < 1_000 or max(costs) <= 3
