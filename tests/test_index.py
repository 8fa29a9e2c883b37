"""Versions of an index: checks before a switch, races, retirement, and the way back after a failure."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from siltstone.sources import files, index


@pytest.fixture
def versions(spark, tmp_path):
    return index.IndexVersions(spark, f"file://{tmp_path}/index", dimensions=3)


def points(spark, n, first=0):
    vector = F.array(*(F.sin(F.col("id") * (i + 2.0) + i).cast("float") for i in range(3)))
    return spark.range(first, first + n).select(F.col("id").cast("string").alias("point_id"), F.col("id").alias("document_id"), vector.alias("embedding"))


def publish(spark, versions, version, n):
    versions.build(points(spark, n), version)
    versions.activate(version)


def test_published_versions_follow_each_other(spark, versions):
    with pytest.raises(index.IndexFailure, match="NO_ACTIVE"):
        versions.current()
    publish(spark, versions, 1, 4)
    publish(spark, versions, 2, 7)
    assert versions.pointer() == (2, 2) and versions.current().count() == 7
    assert [versions.status(v) for v in (1, 2, 3)] == ["RETIRED", "ACTIVE", None]
    other = index.IndexVersions(spark.newSession(), versions.root)
    assert other.current().count() == 7
    versions.activate(1)  # back to the one before
    assert versions.current().count() == 4 and versions.status(2) == "RETIRED"


@pytest.mark.parametrize(
    ("spoil", "code"),
    [
        (lambda p: p.withColumn("point_id", F.lit("same")), "INDEX_POINT_COUNT_MISMATCH"),
        (lambda p: p.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "EMBEDDING_DIMENSION_MISMATCH"),
        (lambda p: p.withColumn("embedding", F.when(F.col("document_id") > 0, F.col("embedding"))), "EMBEDDING_MISSING"),
        (lambda p: p.withColumn("embedding", F.array(*[F.lit(0.0).cast("float")] * 3)), "INDEX_SAMPLE_VALIDATION_FAILED"),
        (lambda p: p.drop("embedding"), "ValueError"),
    ],
)
def test_a_version_that_fails_its_checks_changes_nothing(spark, versions, spoil, code):
    publish(spark, versions, 1, 4)
    with pytest.raises((index.IndexFailure, ValueError)):
        versions.build(spoil(points(spark, 5)), 2)
    assert versions.history(2)[-1] == {"status": "FAILED", "code": code}
    with pytest.raises(index.IndexFailure, match="NOT_READY"):
        versions.activate(2)
    assert versions.pointer() == (1, 1) and versions.current().count() == 4 and versions.status(1) == "ACTIVE"
    versions.build(points(spark, 5), 2)  # a failed version may be built again
    with pytest.raises(index.IndexFailure, match="EXISTS"):
        versions.build(points(spark, 5), 2)


def test_of_two_that_saw_the_same_pointer_one_wins(spark, versions):
    publish(spark, versions, 1, 3)
    for v in (2, 3):
        versions.build(points(spark, v + 3), v)
    seen, _ = versions.pointer()

    def go(version):
        try:
            versions.activate(version, seen)
            return version
        except index.LostRace:
            return None

    with ThreadPoolExecutor(2) as pool:
        won = [v for v in pool.map(go, (2, 3)) if v]
    assert len(won) == 1 and versions.pointer() == (2, won[0])
    assert versions.status(won[0]) == "ACTIVE" and versions.status(5 - won[0]) == "READY" and versions.status(1) == "RETIRED"


def test_what_fails_after_the_switch_takes_it_back(spark, versions):
    publish(spark, versions, 1, 3)
    versions.build(points(spark, 5), 2)
    seen = []

    def after(before):
        seen.append((before, versions.current().count()))
        raise OSError("documents could not be marked")

    with pytest.raises(OSError):
        versions.activate(2, after=after)
    assert seen == [(1, 5)] and versions.pointer() == (3, 1) and versions.current().count() == 3
    assert versions.status(1) == "ACTIVE" and versions.status(2) == "FAILED"
    first = index.IndexVersions(spark, versions.root + "-first")
    first.build(points(spark, 2), 1)
    with pytest.raises(OSError):
        first.activate(1, after=after)
    assert first.pointer() == (2, None)


def test_sweep_keeps_the_newest_retired(spark, versions):
    for v in range(1, 5):
        publish(spark, versions, v, v)
    with pytest.raises(index.IndexFailure):
        versions.build(points(spark, 2).withColumn("point_id", F.lit("x")), 9)
    assert versions.sweep(keep=1) == [1, 2, 9] and versions.sweep(keep=1) == []
    assert files.names(spark, versions.root) == ["pointer", "status", "version=3", "version=4"]


def test_schema_hash_of_a_build(spark, versions):
    versions.build(points(spark, 1), 1, {"model": "m"})
    assert versions.history(1)[0]["schema_hash"] == index.schema_hash({"model": "m"})
    assert versions.build(points(spark, 0), 2) == 0


def test_schemas_and_settings_are_compared(spark):
    from siltstone.plans import corpus_queries
    from siltstone.plans.registry import Tables

    payload = corpus_queries._points(Tables(spark, "/root/testdata/sf0.001"))
    index.check_schema(payload, index.PAYLOAD)
    with pytest.raises(ValueError, match="tags"):
        index.check_schema(payload.drop("tags"), index.PAYLOAD)
    index.check_settings({"size": 64, "distance": "cosine"}, {"distance": "cosine", "size": 64})
    with pytest.raises(index.IndexFailure, match="size"):
        index.check_settings({"size": 64}, {"size": 65, "distance": "cosine"})
