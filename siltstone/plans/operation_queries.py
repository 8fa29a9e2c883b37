"""Queue, worker, state and quality queries; events of a user are the records of one job or worker."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import jobs as J
from siltstone.plans.registry import Tables, query, sql_query


def _now(t: Tables):
    return t.events.agg(F.max("ts").alias("now"))  # one row


@query("SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-01' + INTERVAL 10 DAY - INTERVAL 86400 SECOND AND ts <= (SELECT max(ts) FROM events)")
def incremental_window(t: Tables):
    """Records from a day before the high-water mark, up to a fixed end; re-reads are idempotent."""
    mark = F.lit("2024-01-11").cast("timestamp_ntz")
    return t.events.join(F.broadcast(_now(t))).where((F.col("ts") > mark - F.expr("INTERVAL 86400 SECOND")) & (F.col("ts") <= F.col("now"))).select("event_id", "user_id", "ts")


@query("SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS progress FROM events")
def monotone_progress(t: Tables):
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.round(F.max("value").over(so_far), 6).alias("progress"))


sql_query("event_counters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_seen FROM events GROUP BY event_type")
sql_query("claimable_jobs", "SELECT event_id, ts FROM events WHERE event_type = 'signup' AND user_id % 5 < 3 AND value < 80 ORDER BY ts, event_id LIMIT 10")


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'CANCELLED' WHEN value < 60 THEN 'QUEUED' ELSE 'FAILED' END AS next_state FROM events WHERE event_type = 'view' AND (user_id % 11 = 0 OR ts <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY)""")
def stale_jobs(t: Tables):
    running = t.events.where("event_type = 'view'").join(F.broadcast(_now(t)))
    expired = (F.col("user_id") % 11 == 0) | (F.col("ts") <= F.col("now") - F.expr("INTERVAL 3 DAY"))
    return J.recover(running, expired, F.col("user_id") % 7 == 0, F.col("value") < 60).select("event_id", "next_state")


@query("""SELECT user_id, age, CASE WHEN age <= 86400 THEN 'ONLINE' WHEN age <= 259200 THEN 'DEGRADED' ELSE 'OFFLINE' END AS state FROM (SELECT user_id, date_sub('second', max(ts), (SELECT max(ts) FROM events)) AS age FROM events GROUP BY user_id)""")
def liveness(t: Tables):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(_now(t)))
    return last.select("user_id", J.age_seconds(F.col("last"), F.col("now")).alias("age")).withColumn("state", J.liveness(F.col("age"), 86400, 259200))


@query("""SELECT event_type, arg_max(user_id, (ts, event_id)) AS worker, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY event_type""")
def worker_health(t: Tables):
    """The latest worker of each capability."""
    return t.events.groupBy("event_type").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("worker"), F.countDistinct("user_id").alias("n"))


@query("SELECT event_id, least(300, 15 * pow(2, event_id % 8))::BIGINT AS wait, event_id % 8 >= 6 AS gives_up FROM events")
def retry_backoff(t: Tables):
    return t.events.select("event_id", J.backoff(F.col("event_id") % 8).alias("wait"), (F.col("event_id") % 8 >= 6).alias("gives_up"))


sql_query("active_job_conflicts", "SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 90 GROUP BY user_id, event_type HAVING count(*) > 1")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events")
def rate_window(t: Tables):
    return t.events.select("event_id", J.window_counts(t.events, "user_id", "ts", 86400).alias("n"))


@query("""SELECT o_orderkey, state, CASE WHEN state = 'ACTIVE' OR (state = 'RETIRED' AND place <= 3) OR (state = 'FAILED' AND o_totalprice > 100000) THEN 'KEEP' ELSE 'DELETE' END AS action FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'ACTIVE' WHEN 'F' THEN 'RETIRED' ELSE 'FAILED' END AS state FROM orders))""")
def retention_plan(t: Tables):
    state = F.when(F.col("o_orderstatus") == "P", "ACTIVE").when(F.col("o_orderstatus") == "F", "RETIRED").otherwise("FAILED")
    rows = J.retention(t.orders.withColumn("state", state), "state", "o_orderdate", "o_orderkey", 3, F.col("o_totalprice") > 100000)
    return rows.select("o_orderkey", "state", "action")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(greatest(value, 10)) AS best FROM events GROUP BY user_id")
def job_final_state(t: Tables):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.greatest(F.col("value"), F.lit(10))).alias("best"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS capabilities, max(ts) AS heartbeat FROM events GROUP BY user_id")
def worker_registration(t: Tables):
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("capabilities"), F.max("ts").alias("heartbeat"))


@query("SELECT user_id, CASE WHEN user_id % 4 <> 0 THEN CASE user_id % 4 WHEN 1 THEN 'INITIAL' ELSE 'INCREMENTAL' END WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'INCREMENTAL' ELSE 'INITIAL' END AS mode FROM events GROUP BY user_id")
def mode_resolution(t: Tables):
    asked = F.when(F.col("user_id") % 4 == 0, "AUTO").when(F.col("user_id") % 4 == 1, "INITIAL").otherwise("INCREMENTAL")
    rows = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("done"))
    return rows.select("user_id", J.resolve_mode(asked, F.col("done")).alias("mode"))


@query("""
WITH lease AS (SELECT user_id AS job, user_id % 3 AS worker, max(ts) FILTER (WHERE event_type = 'click') AS h, max(ts) FILTER (WHERE event_type = 'click') + INTERVAL 1 DAY AS e FROM events GROUP BY user_id),
beat AS (SELECT user_id AS job, event_id % 3 AS worker, max(ts) AS beat_at FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT job, worker, greatest(h, beat_at) AS heartbeat_at, greatest(e, beat_at + INTERVAL 3600 SECOND) AS lease_expires_at FROM lease LEFT JOIN beat USING (job, worker)""")
def heartbeat_merge(t: Tables):
    last = F.max(F.when(F.col("event_type") == "click", F.col("ts")))
    leases = t.events.groupBy(F.col("user_id").alias("job")).agg(last.alias("heartbeat_at")).withColumns({"worker": F.col("job") % 3, "lease_expires_at": F.col("heartbeat_at") + F.expr("INTERVAL 1 DAY")})
    beats = t.events.where("event_type = 'view'").select(F.col("user_id").alias("job"), (F.col("event_id") % 3).alias("worker"), F.col("ts").alias("at"))
    return J.merge_heartbeats(leases, beats, "job", "worker", 3600).select("job", "worker", "heartbeat_at", "lease_expires_at")


@query("""
WITH u AS (SELECT c_custkey, c_mktsegment AS role, CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE 'ACTIVE' END AS status, 1 AS version, CASE WHEN c_custkey % 4 <> 3 THEN CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE 1 END END AS actor,
  CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' END AS new_role, c_custkey % 4 = 1 AS block FROM customer),
l AS (SELECT *, role = 'MACHINERY' AND status = 'ACTIVE' AS admin, role = 'MACHINERY' AND status = 'ACTIVE' AND actor IS NOT NULL AND (coalesce(new_role <> 'MACHINERY', false) OR block) AS lowers FROM u),
o AS (SELECT *, CASE WHEN actor IS NULL THEN 'NONE' WHEN actor = c_custkey THEN 'SELF' WHEN lowers AND (SELECT count(*) FROM l WHERE admin AND NOT lowers) < 1 THEN 'LAST_ADMIN' WHEN block AND status = 'BLOCKED' THEN 'UNCHANGED' ELSE 'CHANGED' END AS outcome FROM l)
SELECT c_custkey, CASE WHEN outcome = 'CHANGED' AND new_role IS NOT NULL THEN new_role ELSE role END AS role, CASE WHEN outcome = 'CHANGED' AND block THEN 'BLOCKED' ELSE status END AS status, (version + (outcome = 'CHANGED')::INT)::INT AS version, outcome, outcome = 'CHANGED' AS sessions_revoked FROM o""")
def account_changes(t: Tables):
    """Role changes and blocks by an actor; every tenth asks about itself."""
    users = t.customer.select("c_custkey", F.col("c_mktsegment").alias("role"), F.when(F.col("c_acctbal") < 0, "BLOCKED").otherwise("ACTIVE").alias("status"), F.lit(1).alias("version"))
    asked = t.customer.where("c_custkey % 4 <> 3").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).otherwise(1).alias("actor"), F.when(F.col("c_custkey") % 4 == 0, "BUILDING").alias("new_role"), (F.col("c_custkey") % 4 == 1).alias("block"))
    return J.account_changes(users, asked, "c_custkey", "MACHINERY")


sql_query("bulk_supersede", "SELECT event_id, CASE WHEN event_type = 'view' AND value < 50 THEN 'CANCELLED' ELSE event_type END AS state FROM events")
sql_query("editorial_transitions", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') AND o_orderkey % 2 = 0 THEN 'HIDDEN' WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'OUTDATED' WHEN o_orderstatus = 'P' THEN 'ACTIVE' ELSE o_orderstatus END AS state FROM orders""")
sql_query("history_delete", "SELECT event_id, user_id FROM events WHERE NOT (user_id = 7 AND event_type = 'view') AND event_id NOT IN (SELECT event_id FROM events WHERE user_id = 9)")
sql_query("job_retry_lineage", "SELECT r.event_id, f.event_id AS retry_of FROM events r JOIN events f ON f.user_id = r.user_id AND f.event_id = r.event_id - 150 WHERE f.event_type = 'error'")


@query("SELECT event_id, date_sub('millisecond', prev, ts) AS ms FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)")
def durations(t: Tables):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "ts", before.alias("prev")).select("event_id", F.timestamp_diff("MILLISECOND", F.col("prev"), F.col("ts")).alias("ms"))


@query(r"SELECT event_id, upper(event_type) || '_' || user_id AS code, regexp_matches(upper(event_type) || '_' || user_id, '^[A-Z][A-Z0-9_]*$') AS valid FROM events WHERE json_extract_string(props, '$.k')::INT > 3")
def event_append(t: Tables):
    code = F.concat_ws("_", F.upper("event_type"), F.col("user_id").cast("string"))
    return t.events.where(F.get_json_object("props", "$.k").cast("int") > 3).select("event_id", code.alias("code"), code.rlike("^[A-Z][A-Z0-9_]*$").alias("valid"))


@query("""
WITH blocks AS (SELECT source, doc_id // 100000 AS block, count(*) AS n, min(doc_id) AS first_id, max(n_chars) AS longest, sha256(string_agg(sha256(text), E'\\n' ORDER BY doc_id) || E'\\n') AS h FROM documents WHERE source NOT LIKE 'src1%' GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, min(first_id) AS first_id, max(longest) AS longest, sha256(string_agg(h, E'\\n' ORDER BY block)) AS digest FROM blocks GROUP BY source""")
def corpus_manifest(t: Tables):
    """Counts and an ordered hash of hashes of each source, by blocks of ids so that no group is without bound."""
    rows = t.documents.where(~F.col("source").like("src1%")).select("source", F.floor(F.col("doc_id") / 100_000).alias("block"), "doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    lines = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n")
    blocks = rows.groupBy("source", "block").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("longest"), F.sha2(F.concat(lines("doc_id"), F.lit("\n")), 256).alias("h"))
    return blocks.groupBy("source").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("longest").alias("longest"), F.sha2(lines("block"), 256).alias("digest"))


#: Each check counts rows that should not be.
_CHECKS = {
    "identity_unique": "SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x",
    "required_fields": "SELECT count(*) AS n FROM documents WHERE text IS NULL OR trim(text) = '' OR source IS NULL",
    "accepted_answer_relation": "SELECT count(*) AS n FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
    "selected_answers_present": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_quantity <= 0",
    "tags_normalized": "SELECT count(*) AS n FROM part WHERE p_brand <> lower(trim(p_brand))",
    "chunks_non_empty": "SELECT count(*) AS n FROM conversations WHERE trim(text) = ''",
    "chunk_version_current": "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate",
    "jobs_valid_state": "SELECT count(*) AS n FROM events WHERE value < 0 OR value > 100",
    "audit_credentials_absent": "SELECT count(*) AS n FROM events WHERE lower(props) LIKE '%password%' OR lower(props) LIKE '%token%'",
}
_ALL = " UNION ALL ".join(f"SELECT '{code}' AS code, n AS actual, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({text}) c_{code}" for code, text in _CHECKS.items())
sql_query("quality_checks", _ALL)
sql_query("quality_overall", f"SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall, count(*) AS checks FROM ({_ALL}) q")
sql_query("acceptance", "SELECT (SELECT count(*) FROM documents) >= 500 AS documents, (SELECT count(DISTINCT c_mktsegment) FROM customer) = 5 AS roles, (SELECT count(*) FROM customer) >= 3 AS users")
