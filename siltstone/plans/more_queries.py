"""Whole searches, trusted passages, prompts, index checks and the full chunker."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import retrieval as R
from siltstone.operators.chunking import Limits, chunked
from siltstone.operators.filters import SearchFilters
from siltstone.plans.registry import Tables, query, sql_query
from siltstone.plans.search_queries import _final, fused_where


@query(f"""{fused_where("lang = 'en' AND n_chars >= 300")}, sorted AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS pos FROM final),
grouped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY pos) AS in_group, min(pos) OVER (PARTITION BY item_id, source) AS first FROM sorted) WHERE in_group <= 2),
placed AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY item_id ORDER BY first, pos) AS place, count(*) OVER (PARTITION BY item_id) AS total FROM grouped)
SELECT item_id, doc_id, source, final, substr(text, 1, 160) AS preview, place::BIGINT AS place, total::BIGINT AS total FROM placed WHERE place <= 10""")
def search_pipeline(t: Tables):
    """Filtered before candidates are cut, then fused, visible, reranked, by final score, at most two of a source, first page."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("final"), "doc_id"))
    rows = _final(t, SearchFilters(languages=("en",), least_chars=300)).withColumn("pos", pos)
    grouped = R.group_by(rows, "item_id", "source", "pos", 2)
    page = R.page(grouped, "item_id", [F.col("group_rank"), F.col("pos")], 1, 10)
    return page.select("item_id", "doc_id", "source", "final", F.substring("text", 1, 160).alias("preview"), "place", "total")


@query("""SELECT page_id, host, host IN ('ththre.example.com', 'thther.example.org') OR ends_with(host, '.example.net') AS trusted FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)""")
def trusted_hosts(t: Tables):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    return t.pages.select("page_id", host.alias("host"), (host.isin("ththre.example.com", "thther.example.org") | host.endswith(".example.net")).alias("trusted"))


@query("""SELECT page_id, CASE WHEN ends_with(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.example.com') THEN 'https://example.com/questions/' || regexp_extract(url, '/([0-9]+)(?:[/?#]|$)', 1) END AS canonical FROM pages""")
def canonical_question_url(t: Tables):
    """The one address of a question on an allowed host; null elsewhere."""
    number = F.regexp_extract("url", r"/([0-9]+)(?:[/?#]|$)", 1)
    return t.pages.select("page_id", F.when(F.parse_url(F.col("url"), F.lit("HOST")).endswith(".example.com"), F.concat(F.lit("https://example.com/questions/"), number)).alias("canonical"))


@query("""SELECT item_id, sha256(prompt) AS prompt_hash, greatest(1, (length(prompt) + 3) // 4)::BIGINT AS tokens FROM (SELECT item_id, 'Answer from the sources only. Cite them as [n].' || E'\\n\\nQuestion: ' || text || E'\\n\\nSources:\\n' AS prompt FROM benchmark)""")
def prompt_hash(t: Tables):
    prompt = F.format_string("Answer from the sources only. Cite them as [n].\n\nQuestion: %s\n\nSources:\n", "text")
    return t.benchmark.select("item_id", prompt.alias("p")).select("item_id", F.sha2("p", 256).alias("prompt_hash"), F.greatest(F.lit(1), F.floor((F.length("p") + 3) / 4)).cast("bigint").alias("tokens"))


sql_query("index_counts", "SELECT label, count(*) AS points, count(*) FILTER (WHERE vec_id % 2 = 0) AS matching, min(vec_id) AS sample FROM embeddings GROUP BY label")
sql_query("window_rollover", "SELECT event_type, min(event_id) - 1 AS todate, max(event_id) AS newest FROM events WHERE value > 50 GROUP BY event_type")
sql_query("dump_finalisation", "SELECT event_type, count(*) AS done, greatest(0, 2500 - count(*)) AS needed, CASE WHEN count(*) >= 1990 THEN max(ts) END AS mark FROM events GROUP BY event_type")
sql_query("document_detail", """
SELECT user_id, event_id, event_type, place FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) x WHERE place <= 30""")
@query("""SELECT 'point_count' AS code, (SELECT count(*) FROM embeddings) AS actual, (SELECT count(DISTINCT vec_id) FROM embeddings) AS expected
UNION ALL SELECT 'orphans', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), 0
UNION ALL SELECT 'duplicates_absent', (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1) x), 0
UNION ALL SELECT 'dimensions', (SELECT count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64), 0""")
def index_checks(t: Tables):
    """Counts that should be equal; vectors of another size than the index has are wrong."""
    points = t.embeddings.agg(F.count("*").alias("actual"), F.countDistinct("vec_id").alias("expected")).select(F.lit("point_count").alias("code"), "actual", "expected")
    wrong = lambda code, rows: rows.agg(F.count("*").alias("actual")).select(F.lit(code).alias("code"), "actual", F.lit(0).cast("bigint").alias("expected"))
    orphans = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    copies = t.embeddings.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    sizes = t.embeddings.where(F.col("embedding").isNull() | (F.size("embedding") != 64))
    return points.unionByName(wrong("orphans", orphans)).unionByName(wrong("duplicates_absent", copies)).unionByName(wrong("dimensions", sizes))


sql_query("feedback_upsert", "SELECT user_id, event_type, max(event_id) AS response, count(*) AS writes FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type")


@query()
def chunk_documents(t: Tables):
    """Full chunking: prose and code blocks, merging and overlap; golden tests hold its rules."""
    rows = chunked(t.documents, "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")), Limits(200, 300, 30, 20))
    return rows.select("doc_id", "ordinal", "n_tokens", "has_code", "language", F.sha2("text", 256).alias("digest"))
