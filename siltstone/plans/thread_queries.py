"""Threads: orders are questions, their lineitems are answers (unique with part, supplier and price)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import threads as O
from siltstone.plans.registry import Tables, query

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_answers, coalesce(string_agg(l_linenumber || '/' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), '') AS answers
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderkey""")
def thread_assembly(t: Tables):
    answers = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    rows = O.assemble(t.orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey"), answers, "o_orderkey", [], _ORDER)
    return rows.select("o_orderkey", F.size("answers").cast("bigint").alias("n_answers"), F.array_join(F.transform("answers", lambda a: F.concat_ws("/", a["l_linenumber"].cast("string"), a["l_partkey"].cast("string"))), ",").alias("answers"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS place FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) ORDER BY o_orderkey LIMIT 500""")
def thread_selection(t: Tables):
    """The first 500 tagged questions in file order that are not yet known."""
    known = t.orders.where("o_custkey % 3 = 0").select("o_orderkey")
    found = t.orders.where("o_orderstatus = 'O'").join(known, "o_orderkey", "left_anti").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    first = found.select("o_orderkey").orderBy("o_orderkey").limit(500)
    return first.withColumn("place", F.row_number().over(Window.orderBy("o_orderkey")).cast("bigint"))


@query("""SELECT o_orderkey, CASE WHEN trim(c_name) <> '' AND c_custkey % 5 <> 0 THEN c_name ELSE 'user' || o_custkey END AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def owner_hydration(t: Tables):
    names = t.customer.where("trim(c_name) <> '' AND c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).alias("owner"))


@query("""
SELECT batch, string_agg(k, ';' ORDER BY k) AS ids, count(*)::BIGINT AS n FROM (
  SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')) GROUP BY batch""")
def answer_batches(t: Tables):
    """Requests of at most 100 distinct ids."""
    ids = t.orders.where("o_orderstatus = 'F'").select("o_orderkey").distinct()
    numbered = O.number_rows(ids, "o_orderkey").withColumn("batch", F.floor(F.col("place") / 100))
    return numbered.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";").alias("ids"), F.count("*").alias("n"))


_SELECTED = """
SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, CASE WHEN l_returnflag = 'A' THEN l_linenumber END, l_quantity DESC, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS rank
FROM lineitem l) WHERE rank <= 3"""


def _selected(t: Tables):
    accepted = F.col("l_returnflag") == "A"
    order = [F.when(accepted, F.col("l_linenumber")), F.desc("l_quantity"), F.col("l_shipdate"), *map(F.col, _ORDER)]
    return O.select_answers(t.lineitem, "l_orderkey", accepted, order, 2)


@query(f"SELECT l_orderkey, rank, l_linenumber, l_partkey, l_quantity FROM ({_SELECTED})")
def answer_selection(t: Tables):
    return _selected(t).select("l_orderkey", "rank", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""
WITH s AS ({_SELECTED}),
parts AS (SELECT l_orderkey, string_agg('## ' || CASE WHEN rank = 1 AND l_returnflag = 'A' THEN 'Accepted' ELSE 'Answer ' || rank END || E'\\n\\n' || l_shipdate::DATE || ' ' || l_partkey, E'\\n\\n' ORDER BY rank) AS body FROM s GROUP BY l_orderkey)
SELECT o_orderkey, sha256(txt) AS content_hash, length(txt)::BIGINT AS n_chars, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderdate::DATE) AS metadata_hash
FROM (SELECT o.*, '# ' || o_orderkey || E'\\n\\nTags: ' || o_orderpriority || CASE WHEN body IS NULL THEN '' ELSE E'\\n\\n' || body END AS txt FROM orders o LEFT JOIN parts ON o_orderkey = l_orderkey)""")
def canonical_document(t: Tables):
    label = F.when((F.col("rank") == 1) & (F.col("l_returnflag") == "A"), "Accepted").otherwise(F.concat(F.lit("Answer "), F.col("rank").cast("string")))
    section = F.concat(F.lit("## "), label, F.lit("\n\n"), F.col("l_shipdate").cast("date").cast("string"), F.lit(" "), F.col("l_partkey").cast("string"))
    answers = _selected(t).withColumn("section", section).withColumnRenamed("l_orderkey", "o_orderkey")
    rows = O.assemble(t.orders, answers, "o_orderkey", ["section"], ["rank"])
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Tags: "), "o_orderpriority"), F.transform("answers", lambda a: a["section"]))
    meta = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("date").cast("string"))
    return rows.select("o_orderkey", F.sha2(text, 256).alias("content_hash"), F.length(text).cast("bigint").alias("n_chars"), F.sha2(meta, 256).alias("metadata_hash"))


@query("""
SELECT doc_id, CASE WHEN first_id <> doc_id THEN first_id END AS duplicate_of, CASE WHEN first_id <> doc_id THEN 'EXACT_DUPLICATE' ELSE 'UNIQUE' END AS status
FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id % 10, doc_id) AS first_id FROM documents)""")
def exact_dedup(t: Tables):
    rows = O.exact_duplicates(t.documents, F.col("text"), F.col("doc_id") % 10, "doc_id")
    return rows.select("doc_id", "duplicate_of", F.when(F.col("duplicate_of").isNull(), "UNIQUE").otherwise("EXACT_DUPLICATE").alias("status"))


_CUR = "SELECT doc_id, sha256(text) AS h, 1 + doc_id % 3 AS v FROM documents WHERE doc_id % 5 <> 0"
_INC = "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0"


def _versions(t: Tables):
    current = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"), (1 + F.col("doc_id") % 3).alias("v"))
    incoming = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return O.classify_upserts(current, incoming, "doc_id", "h", "v")


_UPSERT = f"""
SELECT coalesce(c.doc_id, i.doc_id) AS doc_id, CASE WHEN c.h IS NULL THEN 'INSERTED' WHEN i.h IS NULL THEN 'ABSENT' WHEN c.h <> i.h THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome,
  (CASE WHEN c.h IS NULL THEN 1 WHEN c.h <> i.h THEN v + 1 ELSE v END)::BIGINT AS version FROM ({_CUR}) c FULL JOIN ({_INC}) i USING (doc_id)"""


@query(_UPSERT)
def upsert_classify(t: Tables):
    return _versions(t)


@query(f"SELECT outcome, count(*)::BIGINT AS n, max(version)::BIGINT AS newest FROM ({_UPSERT}) GROUP BY outcome")
def import_counters(t: Tables):
    return _versions(t).groupBy("outcome").agg(F.count("*").alias("n"), F.max("version").alias("newest"))


@query("""
SELECT coalesce(a.k, b.k) AS answer, b.k IS NULL AS source_missing, coalesce(b.q, a.q) AS quantity FROM
  (SELECT l_orderkey || '-' || l_linenumber AS k, max(l_quantity) AS q FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) a FULL JOIN
  (SELECT l_orderkey || '-' || l_linenumber AS k, min(l_quantity) AS q FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1) b ON a.k = b.k""")
def answer_reconcile(t: Tables):
    """Stored answers stay and are marked missing where the source no longer has them."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("answer")
    stored = t.lineitem.where("l_orderkey % 3 <> 0").groupBy(key).agg(F.max("l_quantity").alias("quantity"))
    incoming = t.lineitem.where("l_orderkey % 4 <> 0").groupBy(key).agg(F.min("l_quantity").alias("quantity"))
    return O.reconcile_answers(stored, incoming, "answer", "quantity")


@query("""
WITH links AS (SELECT DISTINCT l_orderkey AS doc, p_type AS tag, l_linenumber = 1 AS managed FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT doc, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (WHERE managed), string_agg(tag, ',' ORDER BY tag) FILTER (WHERE NOT managed)) AS tags FROM links GROUP BY doc""")
def effective_tags(t: Tables):
    """Managed tags where there are any, else those of the source."""
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_type").alias("tag"), (F.col("l_linenumber") == 1).alias("managed"))
    return O.effective_tags(links, "doc", "tag", "managed").select("doc", F.array_join("tags", ",").alias("tags"))


@query("""
WITH links AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS tag, l_linenumber % 2 = 0 AS managed FROM lineitem JOIN part ON l_partkey = p_partkey),
fresh AS (SELECT DISTINCT o_orderkey AS doc, o_orderpriority AS tag, false AS managed FROM orders WHERE o_orderkey % 2 = 0)
SELECT doc, tag, managed FROM links WHERE managed OR doc NOT IN (SELECT doc FROM fresh) UNION SELECT doc, tag, managed FROM fresh""")
def tag_replace(t: Tables):
    """Source links of documents that arrive anew are replaced; managed links stay."""
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("tag"), (F.col("l_linenumber") % 2 == 0).alias("managed")).distinct()
    fresh = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("tag"), F.lit(False).alias("managed"))
    return O.replace_tags(links, fresh, "doc", "managed")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, age FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY v DESC)::BIGINT AS age FROM (
  SELECT l_partkey, l_orderkey, l_linenumber, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS v FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem)) ) WHERE age <= 10""")
def revision_retention(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").distinct().withColumn("v", F.expr("l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100"))
    return O.newest_revisions(rows, "l_partkey", "v", 10).select("l_partkey", "l_orderkey", "l_linenumber", "age")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'NOT_INDEXED' ELSE 'OUTDATED' END AS index_status, sha256(o_orderkey || ':2:' || o_custkey) AS chunk_key, 'Edited: ' || o_orderpriority AS contextual_text FROM orders WHERE o_orderkey % 2 = 1""")
def edit_transition(t: Tables):
    """After an edit the index is outdated, unless it never had the document, and chunks are re-keyed."""
    key = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.lit("2"), F.col("o_custkey").cast("string"))
    return t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "NOT_INDEXED").otherwise("OUTDATED").alias("index_status"), F.sha2(key, 256).alias("chunk_key"), F.concat(F.lit("Edited: "), "o_orderpriority").alias("contextual_text"))


@query("""
SELECT o_orderkey, declared, coalesce(stored, 0)::BIGINT AS stored, coalesce(has_accepted, false) AS has_accepted FROM (SELECT o_orderkey, 1 + o_custkey % 6 AS declared FROM orders)
LEFT JOIN (SELECT l_orderkey, count(*) AS stored, bool_or(l_returnflag = 'A') AS has_accepted FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey
WHERE declared > coalesce(stored, 0) OR NOT coalesce(has_accepted, false)""")
def answer_gaps(t: Tables):
    stored = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("stored"), F.bool_or(F.col("l_returnflag") == "A").alias("has_accepted"))
    rows = t.orders.select("o_orderkey", (1 + F.col("o_custkey") % 6).alias("declared")).join(stored, "o_orderkey", "left").fillna({"stored": 0, "has_accepted": False})
    return rows.where("declared > stored OR NOT has_accepted")


@query(r"""
SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'EMPTY' WHEN length(text) < 200 THEN 'TOO_SHORT' WHEN length(text) > 20000 THEN 'TOO_LARGE' WHEN source IN ('src3', 'src7') THEN 'BAD_SOURCE' END AS reject_code,
  CASE WHEN contains(text, '|') THEN 'HAS_TABLE' END AS warning FROM documents""")
def ingest_quality_gate(t: Tables):
    n = F.length("text")
    reject = F.when(F.length(F.trim("text")) == 0, "EMPTY").when(n < 200, "TOO_SHORT").when(n > 20000, "TOO_LARGE").when(F.col("source").isin("src3", "src7"), "BAD_SOURCE")
    return t.documents.select("doc_id", reject.alias("reject_code"), F.when(F.contains("text", F.lit("|")), "HAS_TABLE").alias("warning"))


@query("""SELECT conv_id, turn, role, text[1:260] AS snippet, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, length(text) DESC, turn)::BIGINT AS place FROM conversations WHERE role <> 'system'""")
def public_thread(t: Tables):
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "assistant"), F.desc(F.length("text")), "turn")
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", "role", F.substring("text", 1, 260).alias("snippet"), F.row_number().over(order).cast("bigint").alias("place"))


@query("""
WITH c AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 3 = 0),
base AS (SELECT user_id, event_type, min(event_id) AS event_id, min(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM c WHERE rn = 1 UNION ALL
SELECT user_id, event_type, event_id, round(value, 6) FROM base b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = b.user_id AND c.event_type = b.event_type)""")
def upsert_merge(t: Tables):
    base = t.events.where("event_id % 3 <> 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min("value").alias("value"), F.min("ts").alias("ts"))
    changes = t.events.where("event_id % 3 = 0").select("user_id", "event_type", "event_id", "value", "ts")
    out = O.merge_last_write(base, changes, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def idempotent_append(t: Tables):
    """The first delivery of each request, by request id."""
    first = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("event_id", "user_id")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS id, l_returnflag = 'A' AS flag, l_quantity, l_shipdate, l_suppkey, l_extendedprice, CASE WHEN o_custkey % 3 = 0 THEN 1000000 + o_custkey WHEN o_custkey % 3 = 1 THEN min(l_linenumber * 1000000 + l_partkey) OVER (PARTITION BY l_orderkey) END AS declared
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT * FROM a WHERE l_quantity > 5),
f AS (SELECT *, coalesce(id = coalesce(declared, min(CASE WHEN flag THEN id END) OVER (PARTITION BY l_orderkey)), false) AS accepted FROM u),
r AS (SELECT *, declared IS NOT NULL AND NOT bool_or(accepted) OVER (PARTITION BY l_orderkey) AS missing_accepted, row_number() OVER (PARTITION BY l_orderkey ORDER BY accepted DESC, l_quantity DESC, l_shipdate, id, l_suppkey, l_extendedprice) AS rank FROM f)
SELECT l_orderkey, rank::BIGINT AS rank, id, accepted, missing_accepted FROM r WHERE rank <= 3""")
def corpus_answers(t: Tables):
    """Answers by the rules for declared, flagged, missing and blank ones; a quantity of 5 or less is a blank answer."""
    number = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("id")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("*", number, (F.col("l_returnflag") == "A").alias("flag"))
    least = F.min("id").over(Window.partitionBy("l_orderkey"))
    rows = rows.withColumn("declared", F.when(F.col("o_custkey") % 3 == 0, 1_000_000 + F.col("o_custkey")).when(F.col("o_custkey") % 3 == 1, least))
    order = [F.desc("l_quantity"), *map(F.col, ("l_shipdate", "id", "l_suppkey", "l_extendedprice"))]
    return O.select_corpus_answers(rows, "l_orderkey", "id", "declared", "flag", F.col("l_quantity") > 5, order, 2).select("l_orderkey", "rank", "id", "accepted", "missing_accepted")
