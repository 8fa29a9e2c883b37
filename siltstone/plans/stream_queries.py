"""Streams run to completion over the event table; no SQL counterpart where state is custom."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.registry import Tables, query
from siltstone.sources import pages
from siltstone.sources.files import remove
from siltstone.sources.shared import new_folder
from siltstone.streaming import events as S
from siltstone.streaming import ingestion, jobs
from siltstone.streaming.ordered import rocks


def _run(t: Tables, out):
    """All that is available of a stream, through a checkpointed Parquet sink in the shared folder."""
    root = new_folder(t.spark, "stream")
    out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove(t.spark, f"{root}/checkpoint")
    return t.spark.read.schema(out.schema).parquet(f"{root}/rows")


def _events(t: Tables):
    return S.read_events(t.spark, f"{t.sf_dir}/events.parquet*")


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def stream_distinct(t: Tables):
    rows = _run(t, S.distinct_events(_events(t)).select("event_id", "user_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT * FROM (SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_daily_counts(t: Tables):
    return _run(t, S.daily_counts(_events(t)))


def _to_the_end(t: Tables, events, build):
    """All rows of a stateful stream over events (ts, ...), those that wait for the watermark too.

    When the table has been read, a row far in the future, without any key, is put into a second
    folder of the same stream and takes the watermark past everything that waits.
    """
    root = new_folder(t.spark, "stream")
    end = t.spark.createDataFrame([], events.schema)
    end.write.parquet(f"{root}/end")
    both = events.unionByName(t.spark.readStream.schema(events.schema).parquet(f"{root}/end"))
    out = build(both)
    with rocks(t.spark):
        for _ in range(2):
            out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            last = F.expr("TIMESTAMP '2200-01-01 00:00:00'")
            t.spark.range(1).select(*(last.alias(f.name) if f.name == "ts" else F.lit(-1 if f.name == _KEY else None).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(f"{root}/end")
    for folder in ("checkpoint", "end"):
        remove(t.spark, f"{root}/{folder}")
    return t.spark.read.schema(out.schema).parquet(f"{root}/rows")


#: The column that the closing row carries a key of its own in.
_KEY = "key"


@query()
def stream_rate_limit(t: Tables):
    events = _events(t).select("event_id", F.col("user_id").alias("key"), "ts")
    out = _to_the_end(t, events, lambda e: S.allowed_calls(e.withColumnRenamed("key", "user_id"), 5, 86400))
    return out.where("user_id >= 0")


#: A job is what one user does in one week; what happens is read as the requests of two workers.
POLICY = jobs.Policy(lease=86_400, wait=6 * 3_600, longest_wait=4 * 86_400, stale_wait=3_600)


@query()
def stream_job_transitions(t: Tables):
    week = F.floor(F.unix_seconds("ts") / (7 * 86_400))
    kind = F.expr("CASE event_type WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'HEARTBEAT' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'RETRY' ELSE if(event_id % 5 = 0, 'CANCEL', 'CLAIM') END")
    events = _events(t).select((F.col("user_id") * 10_000 + week).cast("long").alias("key"), "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 2).alias("worker"))
    out = _to_the_end(t, events, lambda e: jobs.job_transitions(e.withColumnRenamed("key", "job"), POLICY))
    return out.where("job >= 0")


_ORDER = "key bigint, status string, price double, ordered string"


def _pages(t: Tables, orders, root: str):
    """A stream of saved pages of orders (key, status, price, ordered)."""
    body = F.to_json(F.struct("key", "status", "price", "ordered"))
    urls = pages.save_pages(orders, ["ordered", "key"], body, f"{root}/pages", 1_000)
    return t.spark.readStream.format(pages.register(t.spark)).option("url", urls).option("spool", f"{root}/spool").load()


@query(
    """WITH bounds AS (SELECT max(o_orderdate) AS hi, max(o_orderdate) - INTERVAL 365 DAY AS mid FROM orders),
    told AS (SELECT o.*, o_orderdate <= mid AS first, o_orderdate > mid - INTERVAL 30 DAY AS second FROM orders o, bounds)
    SELECT o_orderkey AS key, CASE WHEN second AND o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS status,
           CASE WHEN first AND second AND o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS version,
           round(CASE WHEN second AND o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price
    FROM told WHERE first OR second"""
)
def paged_ingestion(t: Tables):
    """Two runs over pages of orders: the second re-reads thirty days in which some orders changed."""
    root = new_folder(t.spark, "ingestion")
    store = ingestion.Store(t.spark, f"{root}/store", "key", _ORDER)
    orders = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("string").alias("ordered"), "o_orderdate")
    hi = F.max("o_orderdate")
    bounds = orders.agg(F.unix_timestamp(hi.cast("timestamp")).alias("hi"), F.unix_timestamp((hi - F.expr("INTERVAL 365 DAYS")).cast("timestamp")).alias("mid")).first()
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    parse = lambda df: df.select(F.from_json("body", _ORDER).alias("i"), "page", "item").select("i.*", "page", "item")
    for name, todate, overlap in (("initial", bounds["mid"], 0), ("incremental", bounds["hi"], 30 * 86_400)):
        since, until = store.window(todate or 0, overlap)
        told = orders.where((at > since) & (at <= until))
        if name == "incremental":
            told = told.withColumns({"price": F.when(F.col("status") == "F", F.col("price") * 2).otherwise(F.col("price")), "status": F.when(F.col("status") == "F", "X").otherwise(F.col("status"))})
        ingestion.run(store, _pages(t, told, f"{root}/{name}"), parse, f"{root}/{name}/checkpoint", name, until, F.to_json(F.struct("status", "price", "ordered")), F.struct("page", "item"))
    for folder in ("pages", "spool", "checkpoint"):
        for name in ("initial", "incremental"):
            remove(t.spark, f"{root}/{name}/{folder}")
    return store.current().select("key", "status", "version", F.round("price", 2).alias("price"))
