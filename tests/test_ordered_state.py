"""Job machine and rate limit against plain folds over the rows in order of time, whatever the batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.plans import registry, stream_queries
from siltstone.streaming import events as S
from siltstone.streaming import jobs
from siltstone.streaming.ordered import rocks

SF = "/root/testdata/sf0.001"
SCHEMA = "job bigint, ts timestamp, event_id bigint, kind string, worker bigint"


def fold(rows, p):
    """Transitions of one job's rows (us, event_id, kind, worker), by a clock that ticks from due time to due time."""
    second = 1_000_000
    job = dict(status=None, attempt=0, worker=None, alarm=None, cancel=False)
    told = []

    def tell(at, code, new=None, event=None, **changes):
        told.append((at, code, job["status"], new or job["status"], job["attempt"], event))
        if new:
            job.update(status=new, worker=None, alarm=None)
        job.update(changes)

    def back(at, code, failure, wait, event=None):
        if job["cancel"]:
            tell(at, "JOB_CANCELLED", "CANCELLED", event)
        elif job["attempt"] == p.attempts:
            tell(at, failure, "FAILED", event)
        else:
            tell(at, code, "QUEUED", event, alarm=at + wait if wait else None)

    def ring():
        at = job["alarm"]
        if job["status"] == "RUNNING":
            back(at, "STALE_JOB_REQUEUED", "WORKER_LEASE_EXPIRED", p.stale_wait * second)
        else:
            job["alarm"] = None
            tell(at, "RETRY_DUE")

    for us, event, kind, worker in sorted(rows):
        while job["alarm"] is not None and job["alarm"] <= us:
            ring()
        if job["status"] is None:
            told.append((us, "JOB_CREATED", None, "QUEUED", 0, event))
            job["status"] = "QUEUED"
            if kind == "CREATE":
                continue
        mine = job["status"] == "RUNNING" and job["worker"] == worker
        match kind, job["status"]:
            case "CANCEL", "CANCELLED":
                pass
            case "CANCEL", "QUEUED":
                tell(us, "JOB_CANCELLED", "CANCELLED", event)
            case "CANCEL", "RUNNING":
                tell(us, "CANCELLATION_REQUESTED", None, event, cancel=True)
            case "CLAIM", "QUEUED" if job["alarm"] is None and job["attempt"] < p.attempts:
                job["attempt"] += 1
                tell(us, "JOB_CLAIMED", "RUNNING", event, worker=worker, alarm=us + p.lease * second)
            case "HEARTBEAT", _ if mine:
                job["alarm"] = max(job["alarm"], us + p.lease * second)
            case "COMPLETE", _ if mine:
                tell(us, "JOB_COMPLETED", "COMPLETED", event)
            case "FAIL", _ if mine:
                tell(us, "JOB_FAILED", "FAILED", event)
            case "RETRY", _ if mine:
                back(us, "RETRY_SCHEDULED", "MAX_ATTEMPTS_EXCEEDED", min(p.longest_wait, p.wait * 2 ** job["attempt"]) * second, event)
            case _:
                tell(us, f"ILLEGAL_{kind}", None, event)
    while job["alarm"] is not None:
        ring()
    return told


def folded(rows, policy):
    by_job = {}
    for job, us, event, kind, worker in rows:
        by_job.setdefault(job, []).append((us, event, kind, worker))
    return Counter((job, *t) for job, r in by_job.items() for t in fold(r, policy))


def read(rows):
    return Counter((r["job"], r["at_us"], r["code"], r["old_status"], r["new_status"], r["attempt"], r["event_id"]) for r in rows)


def test_job_transitions_of_the_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    kinds = {"view": "CLAIM", "click": "HEARTBEAT", "purchase": "COMPLETE", "error": "RETRY"}
    rows = [(r["user_id"] * 10_000 + r["us"] // (7 * 86_400 * 1_000_000), r["us"], r["event_id"], kinds.get(r["event_type"], "CLAIM" if r["event_id"] % 5 else "CANCEL"), r["event_id"] % 2) for r in events.collect()]
    want = folded(rows, stream_queries.POLICY)
    got = read(registry.QUERIES["stream_job_transitions"](spark, SF).collect())
    assert got == want
    codes = Counter(t[2] for t in want.elements())
    assert {"JOB_CANCELLED", "STALE_JOB_REQUEUED", "RETRY_SCHEDULED", "RETRY_DUE", "JOB_COMPLETED", "ILLEGAL_COMPLETE"} <= set(codes)


@pytest.mark.parametrize("files", [1, 4, 9])
def test_transitions_do_not_hang_on_batches(spark, tmp_path, files):
    rng = random.Random(13)
    policy = jobs.Policy(lease=50, wait=7, longest_wait=40, stale_wait=3, attempts=2)
    kinds = ["CREATE", "CLAIM", "CLAIM", "CLAIM", "HEARTBEAT", "HEARTBEAT", "COMPLETE", "FAIL", "RETRY", "RETRY", "CANCEL"]
    rows = [(rng.randrange(25), rng.randrange(0, 900) * 500_000, i, rng.choice(kinds), rng.randrange(2)) for i in range(500)]
    last = max(r[1] for r in rows)
    for part in range(files):  # shuffled over the files, so that later ones hold earlier rows
        mine = [(r[0], r[1], *r[2:]) for r in rows if r[2] % files == part]
        df = spark.createDataFrame(mine, "job bigint, us bigint, event_id bigint, kind string, worker bigint")
        df.select("job", F.timestamp_micros("us").alias("ts"), "event_id", "kind", "worker").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    close = spark.createDataFrame([(-1, last + 5_000_000_000, 0, "CREATE", 0)], "job bigint, us bigint, event_id bigint, kind string, worker bigint")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.job_transitions(stream, policy, "1000 seconds")
    with rocks(spark):
        go = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        go()
        close.select("job", F.timestamp_micros("us").alias("ts"), "event_id", "kind", "worker").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        go()
    got = read(spark.read.parquet(str(tmp_path / "out")).where("job >= 0").collect())
    assert got == folded(rows, policy)


def limited(rows, calls, seconds):
    out, recent = {}, {}
    for us, event, user in sorted(rows):
        mine = recent[user] = [x for x in recent.get(user, []) if x > us - seconds * 1_000_000]
        out[event] = len(mine) < calls
        if out[event]:
            mine.append(us)
    return out


def test_rate_limit_of_the_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()
    got = {r["event_id"]: r["allowed"] for r in registry.QUERIES["stream_rate_limit"](spark, SF).collect()}
    assert got == limited([(r["us"], r["event_id"], r["user_id"]) for r in events], 5, 86_400)


def test_rate_limit_in_time_order_across_batches(spark, tmp_path):
    rng = random.Random(17)
    rows = [(rng.randrange(0, 2_000) * 100_000, i, rng.randrange(3)) for i in range(200)] + [(10_000_000_000, 10_000, -1)]
    for part in (rows[:100], rows[100:200], rows[200:]):
        df = spark.createDataFrame(part, "us bigint, event_id bigint, user_id bigint")
        df.select("event_id", "user_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocks(spark):
        S.allowed_calls(stream, 4, 20, "300 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0").collect()}
    assert got == limited(rows[:-1], 4, 20) and len(set(got.values())) == 2
