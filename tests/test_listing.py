"""Lists: filters that ask nothing, searches, pages and totals."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators.listing import Listing, days_filled, latest, listed


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd", f"Name_{i}%" if i != 7 else None, float(i)) for i in range(1, 31)], "id int, kind string, name string, value double")


def ids(df):
    return [(r["id"], r["place"], r["total"]) for r in df.orderBy("place").collect()]


def test_pages_and_totals(rows):
    assert ids(listed(rows, Listing(size=3), [F.desc("id")])) == [(30, 1, 30), (29, 2, 30), (28, 3, 30)]
    assert ids(listed(rows, Listing(equal={"kind": "odd"}, page=5, size=3), [F.col("id")])) == [(25, 13, 15), (27, 14, 15), (29, 15, 15)]
    assert ids(listed(rows, Listing(page=99), [F.col("id")])) == []
    for wrong in (Listing(page=0), Listing(size=0), Listing(size=1001)):
        with pytest.raises(ValueError):
            listed(rows, wrong, [F.col("id")])


def test_filters(spark, rows):
    found = lambda listing, keys=None: [i for i, *_ in ids(listed(rows, listing, [F.col("id")], keys))]
    assert found(Listing(search="NAME_1", searched=("name",))) == [1, *range(10, 20)]
    assert found(Listing(search="2%", searched=("kind", "name"))) == [2, 12, 22] and found(Listing(search="  ", searched=("name",), size=2)) == [1, 2]
    assert found(Listing(one_of={"kind": ("even",)}, between={"value": (4, 9), "id": (None, 8)})) == [4, 6, 8]
    assert found(Listing(), spark.createDataFrame([(3,), (3,), (99,)], "id int")) == [3]


def test_latest_and_days(spark, rows):
    assert {(r["id"], r["place"]) for r in latest(rows, "kind", [F.desc("id")], 2).collect()} == {(30, 1), (28, 2), (29, 1), (27, 2)}
    seen = spark.createDataFrame([("2024-02-27 10:00:00", 1), ("2024-03-01 00:00:00", 2), ("2024-03-01 23:59:59", 3), ("2024-01-01 00:00:00", 9)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = days_filled(seen, "ts", 4, {"n": F.count("*"), "v": F.sum("v")}).orderBy("day").collect()
    assert [(str(r["day"]), r["n"], r["v"]) for r in got] == [("2024-02-27", 1, 1), ("2024-02-28", 0, 0), ("2024-02-29", 0, 0), ("2024-03-01", 2, 5)]
    assert days_filled(seen.limit(0), "ts", 4, {"n": F.count("*")}).count() == 0
