"""Dashboards, managed lists and details of the application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.listing import Listing, days_filled, latest, listed
from siltstone.plans.registry import Tables, query

_ORDERS = {"newest": "o_orderdate DESC, o_orderkey", "oldest": "o_orderdate, o_orderkey", "title": "o_orderpriority, o_orderkey", "score": "o_totalprice DESC, o_orderkey", "owner": "c_name, o_orderdate DESC, o_orderkey"}
_FOUND = """found AS (SELECT o.*, c_name FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1995-01-01' AND (contains(lower(c_name), '00') OR contains(lower(o_orderpriority), 'high'))
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40)), total AS (SELECT count(*) AS total FROM found)"""


@query(
    f"WITH {_FOUND} "
    + " UNION ALL ".join(f"SELECT '{mode}' AS mode, o_orderkey, c_name, place::BIGINT AS place, total FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM found), total WHERE place BETWEEN 21 AND 40" for mode, order in _ORDERS.items())
)
def managed_documents(t: Tables):
    """The second page of a filtered list in each of its five orders."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    tagged = t.lineitem.join(t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    shown = Listing(one_of={"o_orderstatus": ("O", "F")}, between={"o_orderdate": ("1995-01-01", None)}, page=2)
    either = rows.where(F.contains(F.lower("c_name"), F.lit("00")) | F.contains(F.lower("o_orderpriority"), F.lit("high")))
    orders = {
        "newest": [F.desc("o_orderdate"), F.col("o_orderkey")], "oldest": [F.col("o_orderdate"), F.col("o_orderkey")], "title": [F.col("o_orderpriority"), F.col("o_orderkey")],
        "score": [F.desc("o_totalprice"), F.col("o_orderkey")], "owner": [F.col("c_name"), F.desc("o_orderdate"), F.col("o_orderkey")],
    }
    pages = [listed(either, shown, order, tagged).select(F.lit(mode).alias("mode"), "o_orderkey", "c_name", "place", "total") for mode, order in orders.items()]
    return reduce(DataFrame.unionByName, pages)


_KINDS = {"jobs": ("view", 5, 95), "audit": ("signup", None, None), "failures": ("error", 50, None), "sources": ("purchase", None, 20), "indexes": ("click", 90, None)}


def _between(first, last) -> str:
    return (f" AND value >= {first}" if first is not None else "") + (f" AND value <= {last}" if last is not None else "")


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS list, event_id, row_number() OVER (ORDER BY ts DESC, event_id)::BIGINT AS place, count(*) OVER () AS total FROM events WHERE event_type = '{kind}'{_between(a, b)}) WHERE place <= 15" for name, (kind, a, b) in _KINDS.items()))
def operation_lists(t: Tables):
    """The first pages of the lists of jobs, audit entries, failures, sources and index versions."""
    pages = []
    for name, (kind, first, last) in _KINDS.items():
        shown = Listing(equal={"event_type": kind}, between={"value": (first, last)}, size=15)
        pages.append(listed(t.events, shown, [F.desc("ts"), F.col("event_id")]).select(F.lit(name).alias("list"), "event_id", "place", "total"))
    return reduce(DataFrame.unionByName, pages)


@query(
    """WITH audit AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type IN ('signup', 'click')),
    jobs AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type IN ('error', 'view')),
    answers AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 10000 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem WHERE l_linestatus = 'F')
    SELECT 'audit' AS list, user_id AS document, event_id AS id, place::BIGINT AS place FROM audit WHERE place <= 30 UNION ALL SELECT 'jobs', user_id, event_id, place FROM jobs WHERE place <= 30
    UNION ALL SELECT 'answers', l_orderkey, id, place FROM answers WHERE l_orderkey IN (SELECT DISTINCT user_id FROM events)"""
)
def document_lists(t: Tables):
    """What a document's page shows: its latest thirty audit entries and jobs, and its selected answers, those without a rank last."""
    newest = [F.desc("ts"), F.col("event_id")]
    told = lambda name, kinds: latest(t.events.where(F.col("event_type").isin(*kinds)), "user_id", newest, 30).select(F.lit(name).alias("list"), F.col("user_id").alias("document"), F.col("event_id").alias("id"), "place")
    rank = F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).otherwise(10_000)
    answers = t.lineitem.where("l_linestatus = 'F'").join(t.events.select(F.col("user_id").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    answers = latest(answers, "l_orderkey", [rank, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], 1 << 30)
    shown = answers.select(F.lit("answers").alias("list"), F.col("l_orderkey").alias("document"), (F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey")).alias("id"), "place")
    return told("audit", ("signup", "click")).unionByName(told("jobs", ("error", "view"))).unionByName(shown)


@query(
    """WITH last AS (SELECT max(ts)::DATE AS day FROM events), days AS (SELECT unnest(generate_series(day - INTERVAL 6 DAY, day, INTERVAL 1 DAY))::DATE AS day FROM last),
    seen AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events WHERE user_id % 7 = 3 GROUP BY 1),
    tags AS (SELECT p_brand, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8)
    SELECT 'day' AS part, strftime(days.day, '%Y-%m-%d') AS key, coalesce(n, 0)::BIGINT AS n, coalesce(bad, 0)::BIGINT AS extra FROM days LEFT JOIN seen ON seen.day = days.day UNION ALL
    SELECT 'tag', p_brand, n, 0 FROM tags UNION ALL SELECT 'role', c_mktsegment, count(*), count(*) FILTER (WHERE c_acctbal < 0) FROM customer GROUP BY 2"""
)
def admin_board(t: Tables):
    """The last seven days with those without events, the eight most used tags, and accounts by role with those blocked."""
    some = t.events.where("user_id % 7 = 3").withColumn("bad", F.col("event_type") == "error")
    every = t.events.agg(F.max("ts").alias("ts")).select("ts", F.lit(False).alias("mine"), F.lit(False).alias("bad"))
    rows = some.select("ts", F.lit(True).alias("mine"), "bad").unionByName(every)  # the newest event of all ends the days
    days = days_filled(rows, "ts", 7, {"n": F.count_if("mine"), "extra": F.count_if(F.col("mine") & F.col("bad"))}).select(F.lit("day").alias("part"), F.col("day").cast("string").alias("key"), "n", "extra")
    tags = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(8)
    roles = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("extra"))
    return days.unionByName(tags.select(F.lit("tag").alias("part"), F.col("p_brand").alias("key"), "n", F.lit(0).cast("bigint").alias("extra"))).unionByName(roles.select(F.lit("role").alias("part"), F.col("c_mktsegment").alias("key"), "n", "extra"))


@query(
    """WITH state AS (SELECT *, o_orderpriority = '1-URGENT' OR o_totalprice > 200000 AS attention FROM orders)
    SELECT 'status' AS part, o_orderstatus AS key, count(*)::BIGINT AS n, 0::BIGINT AS place FROM state GROUP BY 2 UNION ALL SELECT 'attention', 'all', count(*) FILTER (WHERE attention), 0 FROM state UNION ALL
    SELECT 'newest', o_orderkey::VARCHAR, o_custkey, place FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM state) WHERE place <= 5 UNION ALL
    SELECT 'urgent', o_orderkey::VARCHAR, o_custkey, place FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM state WHERE attention) WHERE place <= 5"""
)
def editor_board(t: Tables):
    """Documents by state, how many need attention, and the first five of each list."""
    state = t.orders.withColumn("attention", (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 200000))
    zero = F.lit(0).cast("bigint")
    counts = state.groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("part"), "key", "n", zero.alias("place"))
    needs = state.agg(F.count_if("attention").alias("n")).select(F.lit("attention").alias("part"), F.lit("all").alias("key"), "n", zero.alias("place"))
    top = lambda part, rows, order: listed(rows, Listing(size=5), order).select(F.lit(part).alias("part"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("n"), "place")
    newest, urgent = top("newest", state, [F.desc("o_orderdate"), F.col("o_orderkey")]), top("urgent", state.where("attention"), [F.desc("o_totalprice"), F.col("o_orderkey")])
    return counts.unionByName(needs).unionByName(newest).unionByName(urgent)


@query(
    """SELECT user_id, event_id, place::BIGINT AS place, actions, audited FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type = 'view')
    JOIN (SELECT user_id, count(*)::BIGINT AS actions, count(*) FILTER (WHERE event_type = 'signup' OR event_id % 10 = user_id % 10)::BIGINT AS audited FROM events GROUP BY 1) USING (user_id) WHERE place <= 10"""
)
def account_detail(t: Tables):
    """Each account's latest ten searches, with its actions and the audit entries by it or about it."""
    sums = t.events.groupBy("user_id").agg(F.count("*").alias("actions"), F.count_if((F.col("event_type") == "signup") | (F.col("event_id") % 10 == F.col("user_id") % 10)).alias("audited"))
    shown = latest(t.events.where("event_type = 'view'"), "user_id", [F.desc("ts"), F.col("event_id")], 10).select("user_id", "event_id", "place")
    return shown.join(sums, "user_id")


@query(
    """SELECT target, have, greatest(0, target - have)::BIGINT AS needed, CASE WHEN greatest(0, target - have) = 0 THEN 'NONE' WHEN target - have <= 100 THEN 'ANSWERLESS' ELSE 'ALL' END AS mode,
    (CASE WHEN target - have BETWEEN 1 AND 100 THEN target - have + 10 ELSE greatest(0, target - have) END)::BIGINT AS fetched
    FROM (SELECT count(*)::BIGINT AS have FROM orders WHERE o_orderstatus = 'F'), (SELECT unnest([0, 100, 700, 7000, 7300, 7400, 8000, 80000])::BIGINT AS target)"""
)
def target_arithmetic(t: Tables):
    """How many documents an import still needs; the last hundred are filled with questions that nobody answered, and ten to spare."""
    targets = t.spark.createDataFrame([(x,) for x in (0, 100, 700, 7000, 7300, 7400, 8000, 80000)], "target bigint")
    have = t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("have"))
    needed = F.greatest(F.lit(0), F.col("target") - F.col("have"))
    rows = targets.crossJoin(F.broadcast(have)).withColumn("needed", needed)
    return rows.select("target", "have", "needed", F.when(F.col("needed") == 0, "NONE").when(F.col("needed") <= 100, "ANSWERLESS").otherwise("ALL").alias("mode"), F.when(F.col("needed").between(1, 100), F.col("needed") + 10).otherwise(F.col("needed")).alias("fetched"))
