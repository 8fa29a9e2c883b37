import json

import pytest

from pyspark.sql import functions as F

from siltstone.sources import dump, index
from siltstone.streaming import events as S
from siltstone.streaming.ordered import rocks

XML = """<?xml version="1.0"?><posts>
<row Id="1" PostTypeId="1" CreationDate="2024-01-01T00:00:00.000" Score="3" Body="&lt;p&gt;q&lt;/p&gt;" Title="T" Tags="&lt;python&gt;&lt; a &gt;" AnswerCount="2" AcceptedAnswerId="3" OwnerUserId="9" />
<row Id="2" PostTypeId="2" ParentId="1" CreationDate="2024-01-02T00:00:00.000" Score="1" Body="x" />
<row Id="3" PostTypeId="2" ParentId="1" CreationDate="2024-01-03T00:00:00.000" Body="y" />
<row Id="4" PostTypeId="1" CreationDate="2024-01-04T00:00:00.000" Title="U" Tags="&lt;java&gt;" Body="z" />
</posts>"""


def test_threads_of_a_dump(spark, tmp_path):
    (tmp_path / "Posts.xml").write_text(XML)
    rows = dump.read_rows(spark, str(tmp_path / "Posts.xml"))
    known = spark.createDataFrame([], "question_id bigint")
    got = dump.threads(rows, "Python", known, 10).collect()
    assert [(r["question_id"], r["tags"], r["is_answered"], r["owner"]["user_id"]) for r in got] == [(1, ["python", "a"], True, 9)]
    assert [(a["answer_id"], a["score"], a["is_accepted"]) for a in got[0]["answers"]] == [(2, 1, False), (3, 0, True)]
    assert dump.threads(rows, "python", spark.createDataFrame([(1,)], "question_id bigint"), 10).count() == 0


def test_threads_by_id(spark, tmp_path):
    (tmp_path / "Posts.xml").write_text(XML)
    rows = dump.read_rows(spark, str(tmp_path / "Posts.xml"))
    got = dump.threads_by_id(rows, spark.createDataFrame([(1,), (4,), (4,), (2,), (77,)], "question_id bigint")).orderBy("question_id").collect()
    assert [(r["question_id"], [a["answer_id"] for a in r["answers"]]) for r in got] == [(1, [2, 3]), (4, [])]


def test_schema_hash_ignores_order():
    a, b = {"model": "m", "size": 64, "quantization": None}, {"quantization": None, "size": 64, "model": "m"}
    assert index.schema_hash(a) == index.schema_hash(b) != index.schema_hash(a | {"size": 65})


def test_pages_ignore_unknown_fields_and_errors(spark, tmp_path):
    pages = [{"items": [{"question_id": 1, "title": "a", "new_field": 1}], "has_more": True}, {"error_id": 502, "error_message": "throttled"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, pages)))
    assert [(r["question_id"], r["title"]) for r in dump.read_pages(spark, str(tmp_path)).collect()] == [(1, "a")]


def test_ingestion_resumes_from_its_checkpoint(spark, tmp_path):
    def write(ids):
        rows = spark.createDataFrame([(i, i % 2) for i in ids], "event_id bigint, user_id bigint")
        rows.select("event_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen = []
    sink = lambda df, epoch: seen.extend(r["event_id"] for r in df.collect())
    write([1, 2])
    S.ingest(S.read_events(spark, str(tmp_path / "in")), str(tmp_path / "cp"), sink)
    write([3])
    S.ingest(S.read_events(spark, str(tmp_path / "in")), str(tmp_path / "cp"), sink)
    assert sorted(seen) == [1, 2, 3]


def test_rate_limit_does_not_count_refused_calls(spark, tmp_path):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate((0, 1, 2, 9, 10, 11))], "event_id bigint, s bigint")
    rows.select("event_id", F.timestamp_seconds(F.col("s")).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("v").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = S.allowed_calls(S.read_events(spark, str(tmp_path / "in")).select("event_id", "user_id", "ts"), 2, 10, "0 seconds")
    with rocks(spark):
        out.writeStream.format("memory").queryName("limited").trigger(availableNow=True).start().awaitTermination()
    assert [r["allowed"] for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, False, True, True]


def test_answered_questions(spark, tmp_path):
    good = [{"id": "r1", "query": "q", "expectedExternalIds": ["a"], "requiredPoints": ["p"], "expectedInsufficient": True, "extra": 1}, {"id": "r2", "query": "z"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, good)))
    rows = dump.read_answered(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["expected"], r["points"], r["refuse"]) for r in rows] == [("r1", ["a"], ["p"], True), ("r2", [], [], False)]
    for i, line in enumerate(("{", json.dumps({"id": "x"}), json.dumps({"id": " ", "query": "q"}))):
        (tmp_path / f"bad{i}.jsonl").write_text(line)
        with pytest.raises(Exception, match="broken"):
            dump.read_answered(spark, str(tmp_path / f"bad{i}.jsonl")).collect()
