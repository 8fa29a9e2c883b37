"""Operational analytics in SQL.

Roles of the tables: customers are users and their market segment is the role; suppliers belong
to nations, which are sources; parts are tagged by type and brand; orders are documents with
lineitems as answers or chunks; events are search runs, jobs, history and audit records, whose
latest timestamp stands for now.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.registry import Tables, query, sql_query

sql_query("users_with_roles", "SELECT c_custkey, c_name, c_mktsegment AS role, n_name AS home FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_mktsegment, c_name")
sql_query("chunks_per_source", """
SELECT n_name, count(DISTINCT o_orderkey) AS documents, count(l_orderkey) AS chunks, round(coalesce(sum(l_quantity), 0), 2) AS quantity
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""")
sql_query("users_by_role_status", "SELECT c_mktsegment AS role, CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE 'ACTIVE' END AS status, count(*) AS n FROM customer GROUP BY 1, 2")
sql_query("popular_tags", """
SELECT p_type AS tag, count(DISTINCT l_orderkey) AS documents FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type ORDER BY documents DESC, tag LIMIT 10""")
sql_query("job_success_rate", """
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 20) AS done, round(100.0E0 * count(*) FILTER (WHERE value > 20) / nullif(count(*), 0), 2) AS rate,
  round(100.0E0 * count(*) FILTER (WHERE value > 20) / nullif(count(*) FILTER (WHERE user_id % 10 <> 0), 0), 2) AS rate_finished FROM events GROUP BY event_type""")
sql_query("audit_of_actor", "SELECT event_id, event_type, ts FROM events WHERE user_id = 7 OR CAST(event_id AS VARCHAR(20)) = '42' ORDER BY ts DESC, event_id DESC LIMIT 20")
sql_query("unready_documents", "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('P', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
sql_query("documents_without_chunks", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
sql_query("chunks_per_document", """
SELECT o_orderpriority, round(avg(n), 9) AS mean, max(n) AS most FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) x GROUP BY o_orderpriority""")
sql_query("status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
sql_query("duplicates_with_canonical", """
SELECT d.doc_id, c.doc_id AS canonical_id, c.source AS canonical_source FROM documents d
JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1) f ON d.text = f.text JOIN documents c ON c.doc_id = f.first_id WHERE d.doc_id <> c.doc_id""")
sql_query("revision_numbers", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS revision FROM orders")
sql_query("changed_after_index", """
SELECT o_orderkey, o_orderdate, indexed FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS indexed FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) x ON l_orderkey = o_orderkey
WHERE indexed IS NULL OR o_orderdate > indexed ORDER BY indexed DESC NULLS LAST, o_orderkey LIMIT 300""")
sql_query("failure_share", """
WITH failed AS (SELECT user_id, count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY user_id), total AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT t.user_id, coalesce(failed, 0) AS failed, n, round(1.0E0 * failed / n, 4) AS share FROM total t LEFT JOIN failed f ON f.user_id = t.user_id ORDER BY share DESC NULLS LAST, t.user_id""")
sql_query("sources_with_checkpoint", "SELECT s_suppkey, s_name, n_name, round(s_acctbal, 2) AS balance FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2")
sql_query("answers_of_document", "SELECT l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_orderkey = 97 ORDER BY l_quantity DESC NULLS LAST, l_shipdate, l_partkey")
sql_query("latest_event_per_user", """
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1""")
sql_query("latency_last_day", """
SELECT event_type, count(*) AS runs, round(avg(value), 9) AS mean, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 9) AS p95, count(*) FILTER (WHERE value > 60) AS slow
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type""")
sql_query("validity_by_model", "SELECT user_id % 5 AS model, round(avg(value) FILTER (WHERE event_type <> 'error'), 9) AS latency, round(1.0E0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 4) AS valid FROM events GROUP BY 1")
sql_query("citation_mapping", """
SELECT o_orderkey, l_linenumber AS citation, p_name, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
sql_query("latest_documents", "SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
sql_query("users_per_role", "SELECT r.role, count(c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment AS role FROM customer UNION ALL SELECT 'AUDITOR') r LEFT JOIN customer ON c_mktsegment = r.role AND c_acctbal > 0 GROUP BY r.role")
sql_query("jobs_by_type_status", "SELECT event_type, CASE WHEN value < 10 THEN 'FAILED' WHEN value < 90 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
sql_query("largest_documents", "SELECT o_orderkey, count(*) AS chunks FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey ORDER BY chunks DESC, o_orderkey LIMIT 20")
sql_query("no_successful_entry", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey AND p.p_size > 10)")
sql_query("latest_job_per_source", """
WITH ranked AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN ranked ON o_custkey = c_custkey AND rn = 1""")
sql_query("tag_rank", "WITH counts AS (SELECT p_brand AS tag, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand) SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS place FROM counts")
sql_query("mean_answers", "SELECT round(avg(n), 6) AS mean FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority NOT LIKE '5%' GROUP BY o_orderkey) x")
sql_query("history_by_day", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2")
sql_query("daily_series_filled", """
WITH days AS (SELECT CAST(x AS DATE) AS day FROM (SELECT DISTINCT date_trunc('day', ts) AS x FROM events) d WHERE x > (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
seen AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' AND user_id % 50 = 3 GROUP BY 1)
SELECT d.day, coalesce(n, 0) AS n FROM days d LEFT JOIN seen s ON s.day = d.day""")
sql_query("admin_dashboard", """
SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(CASE WHEN event_type = 'click' THEN value END), 9) AS click_ms,
  round(1.0E0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*), 6) AS valid_share, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 DAY""")
sql_query("editor_dashboard", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 200000) AS attention, max(o_orderdate) AS newest FROM orders GROUP BY o_orderstatus")
sql_query("ingestion_stats", """
SELECT count(*) AS answers, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(*) FILTER (WHERE l_linestatus = 'O') AS open, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(DISTINCT l_orderkey) AS threads, round(sum(l_quantity), 2) AS quantity FROM lineitem""")
sql_query("user_stats_correlated", """
WITH docs AS (SELECT o_custkey, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey), ran AS (SELECT user_id, count(*) AS runs FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(documents, 0) AS documents, coalesce(open, 0) AS open, coalesce(runs, 0) AS runs, coalesce(documents, 0) + coalesce(runs, 0) AS activity FROM customer LEFT JOIN docs ON o_custkey = c_custkey LEFT JOIN ran ON user_id = c_custkey""")
sql_query("saved_documents", """
SELECT DISTINCT user_id, o_orderkey, o_orderpriority FROM events JOIN orders ON o_orderkey = event_id % 3000 JOIN customer ON c_custkey = o_custkey
WHERE event_type = 'click' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
_LISTED = """
SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey
WHERE (lower(c_name) LIKE '%00%' OR lower(o_orderpriority) LIKE '%high%') AND o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)"""
sql_query("document_listing", f"""
WITH listed AS ({_LISTED}) SELECT o_orderkey, o_orderdate, c_name, (SELECT count(*) FROM listed) AS total FROM listed ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
sql_query("history_listing", "SELECT event_id, ts, event_type FROM events WHERE user_id = 12 AND lower(event_type) LIKE '%i%' AND value BETWEEN 5 AND 95 ORDER BY ts, event_id")
sql_query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 256")
sql_query("bulk_outcomes", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'SKIPPED' WHEN o_totalprice > 300000 THEN 'FAILED' ELSE 'DONE' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
sql_query("stale_count", "SELECT greatest(0, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') - (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linestatus = 'F')) AS stale")
sql_query("role_permissions", "SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
sql_query("last_admin_rule", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS admins, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') > 1 AS may_block FROM customer GROUP BY c_nationkey")
sql_query("public_status", "SELECT count(*) AS documents, coalesce(sum(n_chars), 0) > 0 AS any_text, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents WHERE source <> 'src5'")


@query("""
SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS tags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' LEFT JOIN part ON p_partkey = l_partkey
GROUP BY o_orderkey, o_orderpriority, l_linenumber, l_partkey ORDER BY o_orderkey, l_linenumber NULLS FIRST, l_partkey NULLS FIRST LIMIT 30""")
def documents_answers_tags(t: Tables):
    """The first documents, with their selected answers and the distinct tags of each."""
    answers = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = t.orders.select("o_orderkey", "o_orderpriority").join(answers, "o_orderkey", "left").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
    tags = rows.groupBy("o_orderkey", "o_orderpriority", "l_linenumber", "l_partkey").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("p_brand")), ", "), F.lit("")).alias("tags"))
    return tags.orderBy("o_orderkey", "l_linenumber", "l_partkey").limit(30)


sql_query("chunks_of_document", """
SELECT l_orderkey, l_linenumber AS ordinal, revision AS version, l_quantity, place FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 3 AS INTEGER) AS revision, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3 DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem) x""")


@query("""
SELECT o_orderkey, o_orderpriority, e.l_linenumber, e.l_shipdate, e.l_partkey FROM orders LEFT JOIN LATERAL (
  SELECT l_linenumber, l_shipdate, l_partkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N' ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC LIMIT 1) e ON true WHERE o_orderstatus IN ('O', 'P')""")
def active_jobs_latest_event(t: Tables):
    """Active jobs with their latest event, and those without any."""
    fields = ("l_shipdate", "l_linenumber", "l_partkey")
    last = t.lineitem.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct(*fields)).alias("e"))
    return t.orders.where("o_orderstatus IN ('O', 'P')").join(last, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", *(F.col(f"e.{f}").alias(f) for f in fields))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def documents_without_index(t: Tables):
    """Documents that are pending or have no indexed chunk; NOT IN as a join by key: a null among the chunks' keys leaves no document unindexed."""
    indexed = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(True).alias("indexed"))
    told = indexed.agg(F.count("*").alias("keys"), F.count_if(F.col("o_orderkey").isNull()).alias("nulls"))
    rows = t.orders.select("o_orderkey", "o_orderstatus").join(indexed, "o_orderkey", "left").crossJoin(F.broadcast(told))
    unindexed = (F.col("keys") == 0) | (F.col("o_orderkey").isNotNull() & F.col("indexed").isNull() & (F.col("nulls") == 0))
    return rows.where((F.col("o_orderstatus") == "P") | unindexed).select("o_orderkey", "o_orderstatus")
