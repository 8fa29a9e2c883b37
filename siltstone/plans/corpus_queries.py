"""Gates, canonical threads, payloads and index checks over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import corpus as C
from siltstone.operators import threads as O
from siltstone.operators.filters import SearchFilters
from siltstone.plans.registry import Tables, query
from siltstone.plans.search_queries import _FOLD, _chunks

#: A question is an order, its answers the order's lines; texts are as long as numbers say.
_LIMITS = C.Limits(answers=6, question=20, answer=3, text=45)
_THREADS = """
q AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 50 = 3 THEN '  ' ELSE o_orderpriority END AS title, repeat('w', (o_custkey % 60)::INT) AS text,
  CASE WHEN o_orderkey % 41 = 5 THEN 'ftp://x' ELSE 'https://example.com/q/' || o_orderkey END AS url, CASE WHEN o_custkey % 3 = 0 THEN 1 + o_custkey % 6 END AS accepted_id FROM orders),
a AS (SELECT l_orderkey AS asked, l_linenumber AS answer_id, CASE WHEN l_suppkey % 97 = 7 THEN l_orderkey + 1 ELSE l_orderkey END AS question_id, repeat('a', l_quantity::INT) AS text FROM lineitem)"""


@query(
    f"""WITH {_THREADS.strip()},
    n AS (SELECT asked, count(*) AS n FROM a GROUP BY 1),
    r AS (SELECT q.*, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 6 THEN 'TOO_MANY_ANSWERS' WHEN trim(title) = '' THEN 'EMPTY_TITLE' WHEN length(text) > 45 THEN 'CLEANED_CONTENT_TOO_LARGE'
      WHEN length(text) < 20 THEN 'QUESTION_TOO_SHORT' WHEN url LIKE 'ftp%' THEN 'INVALID_SOURCE_URL' END AS reject FROM q LEFT JOIN n ON asked = question_id),
    w AS (SELECT asked, answer_id::VARCHAR AS answer_id, CASE WHEN question_id <> asked THEN 'ANSWER_QUESTION_MISMATCH' WHEN length(text) > 45 THEN 'CLEANED_CONTENT_TOO_LARGE' WHEN length(text) < 3 THEN 'ANSWER_TOO_SHORT' END AS code FROM a
      UNION ALL SELECT question_id, accepted_id::VARCHAR, 'ACCEPTED_ANSWER_MISSING' FROM q WHERE accepted_id IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM a WHERE a.asked = q.question_id AND a.question_id = q.question_id AND a.answer_id = q.accepted_id AND length(a.text) BETWEEN 3 AND 45))
    SELECT r.question_id, r.reject, CASE WHEN r.reject IS NULL THEN coalesce(string_agg(answer_id || ':' || code, ',' ORDER BY answer_id, code) FILTER (WHERE code IS NOT NULL), '') ELSE '' END AS warnings
    FROM r LEFT JOIN w ON w.asked = r.question_id GROUP BY r.question_id, r.reject"""
)
def thread_gates(t: Tables):
    """What is wrong with a thread, and what with its answers, which does not reject it."""
    key = F.col("o_orderkey")
    q = t.orders.select(
        key.alias("question_id"), F.when(key % 50 == 3, "  ").otherwise(F.col("o_orderpriority")).alias("title"), F.repeat(F.lit("w"), (F.col("o_custkey") % 60).cast("int")).alias("text"),
        F.when(key % 41 == 5, "ftp://x").otherwise(F.concat(F.lit("https://example.com/q/"), key.cast("string"))).alias("url"), F.when(F.col("o_custkey") % 3 == 0, 1 + F.col("o_custkey") % 6).alias("accepted_id"),
    )
    a = t.lineitem.select(
        F.col("l_orderkey").alias("asked"), F.struct(F.col("l_linenumber").cast("bigint").alias("answer_id"), F.when(F.col("l_suppkey") % 97 == 7, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("question_id"), F.repeat(F.lit("a"), F.col("l_quantity").cast("int")).alias("text")).alias("answer"),
    ).groupBy(F.col("asked").alias("question_id")).agg(F.collect_list("answer").alias("answers"))
    threads = q.join(a, "question_id", "left").withColumn("answers", F.coalesce("answers", F.array()))
    told = F.array_join(F.transform("warnings", lambda w: F.concat(w["answer_id"], F.lit(":"), w["code"])), ",")
    return C.gate(threads, _LIMITS).select("question_id", "reject", told.alias("warnings"))


#: The first user turn asks, assistant turns answer, the longest of them is accepted where the conversation's number is even.
_SAID = "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1 AND conv_id % 2 = 0 AS accepted FROM conversations WHERE role = 'assistant'"


@query(
    rf"""WITH asked AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
    titled AS (SELECT *, trim(substr(split_part(text, E'\n', 1), 1, 40)) AS title, CASE WHEN conv_id % 3 = 0 THEN ['a', 'b' || conv_id % 5] ELSE ['c'] END AS tags FROM asked),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY accepted DESC, turn) AS place, row_number() OVER (PARTITION BY conv_id, accepted ORDER BY turn) AS further FROM ({_SAID})),
    joined AS (SELECT conv_id, string_agg('## ' || CASE WHEN accepted THEN '{C.ACCEPTED}' ELSE '{C.FURTHER} ' || further END || CASE WHEN text = '' THEN '' ELSE E'\n\n' || text END, E'\n\n' ORDER BY place) AS body,
      string_agg('{{"text":' || to_json(text) || ',"type":"' || CASE WHEN accepted THEN 'ACCEPTED_ANSWER' ELSE 'ANSWER' END || '"}}', ',' ORDER BY place) AS value FROM s GROUP BY conv_id)
    SELECT t.conv_id, sha256(regexp_replace('# ' || title || E'\n\nТеги: ' || array_to_string(tags, ', ') || E'\n\n## {C.QUESTION}' || CASE WHEN text = '' THEN '' ELSE E'\n\n' || text END || coalesce(E'\n\n' || body, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS text_hash,
      sha256('{{"sections":[{{"text":' || to_json(text) || ',"type":"QUESTION"}}' || coalesce(',' || value, '') || '],"tags":[' || array_to_string(list_transform(tags, lambda x: to_json(x)), ',') || '],"title":' || to_json(title) || '}}') AS content_hash
    FROM titled t LEFT JOIN joined j ON t.conv_id = j.conv_id"""
)
def canonical_threads(t: Tables):
    """Canonical texts of many lines, with their sections' labels, and the hash of their contents."""
    asked = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    own = F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 40))
    tags = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")))).otherwise(F.array(F.lit("c")))
    said = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct(F.length("text"), -F.col("turn"))).alias("best"), F.collect_list(F.struct("turn", "text")).alias("rows"))
    chosen = F.transform("rows", lambda r: F.struct((~((F.col("conv_id") % 2 == 0) & (r["turn"] == -F.col("best.col2")))).alias("later"), r["turn"].alias("turn"), r["text"].alias("text")))
    said = said.select("conv_id", F.transform(F.array_sort(chosen), lambda r: F.struct((~r["later"]).alias("accepted"), r["text"].alias("text"))).alias("answers"))
    threads = asked.join(said, "conv_id", "left").withColumns({"title": own, "tags": tags, "answers": F.coalesce("answers", F.array().cast("array<struct<accepted:boolean,text:string>>"))})
    return C.canonical(threads).select("conv_id", F.sha2("canonical", 256).alias("text_hash"), "content_hash")


#: Documents as the corpus holds them: states follow from numbers, and where a text stands twice its first document is unique.
_STATES = """SELECT d.doc_id, d.text, source, lang, 1 + d.doc_id % 3 AS version, sha256(d.text) AS content_hash, CASE WHEN d.doc_id % 11 = 3 THEN 'HIDDEN' WHEN d.doc_id % 4 = 1 THEN 'OUTDATED' ELSE 'ACTIVE' END AS status,
  CASE WHEN d.doc_id % 13 = 5 THEN 'FAILED' ELSE 'CHUNKED' END AS processing_status, CASE WHEN first_id <> d.doc_id THEN 'EXACT_DUPLICATE' ELSE 'UNIQUE' END AS deduplication_status,
  CASE WHEN d.doc_id % 17 = 2 THEN 'E' END AS processing_error FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1) f ON f.h = sha256(d.text)"""


def _states(t: Tables):
    n = F.col("doc_id")
    first = O.exact_duplicates(t.documents, F.col("text"), n * 0, "doc_id")
    return first.select(
        n.alias("document_id"), (1 + n % 3).alias("version"), "content_hash", F.col("source").alias("source_id"), F.lit("QA").alias("source_type"), F.concat(F.lit("https://example.com/questions/"), n.cast("string")).alias("source_url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.array("lang", F.lit("all"), "lang").alias("tags"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd").alias("published_at"),
        (n % 50).alias("score"), (n % 7).alias("answers_count"), F.when(n % 2 == 0, n).alias("accepted_id"), F.contains("text", F.lit("|")).alias("has_code"), "lang",
        F.when(n % 11 == 3, "HIDDEN").when(n % 4 == 1, "OUTDATED").otherwise("ACTIVE").alias("status"), F.when(n % 13 == 5, "FAILED").otherwise("CHUNKED").alias("processing_status"),
        F.when(F.col("duplicate_of").isNull(), "UNIQUE").otherwise("EXACT_DUPLICATE").alias("deduplication_status"), F.when(n % 17 == 2, "E").alias("processing_error"),
    )


def _index_chunks(t: Tables):
    """Chunks of all documents; some are of an older version."""
    rows = _chunks(t).withColumnRenamed("doc_id", "document_id")
    key = F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.col("ordinal").cast("string"), "text"), 256)
    version = 1 + F.col("document_id") % 3 - F.when((F.col("document_id") + F.col("ordinal")) % 19 == 0, 1).otherwise(0)
    return rows.select("document_id", key.alias("chunk_id"), "ordinal", version.alias("document_version"), F.sha2("text", 256).alias("chunk_hash"), "text", F.concat(F.lit("context\n"), "text").alias("contextual_text"), F.contains("text", F.lit("#")).alias("chunk_code"), F.when(F.col("ordinal") == 0, "QUESTION").otherwise("ANSWER").alias("section_type"), F.lit(None).cast("string").alias("language"))


_INDEXED_AT, _SCHEMA = "2024-06-01T00:00:00+00:00", "v3"
_POINTS = rf"""states AS ({_STATES}), chunks AS ({_FOLD}),
points AS (SELECT sha256(c.doc_id || ':' || ordinal || ':' || c.text) AS chunk_id, c.doc_id::VARCHAR AS document_id, version AS document_version, ordinal AS chunk_ordinal, sha256(c.text) AS chunk_content_hash, content_hash AS document_content_hash, source AS source_id,
  'QA' AS source_type, 'https://example.com/questions/' || c.doc_id AS source_url, substr(split_part(s.text, E'\n', 1), 1, 60) AS title, CASE WHEN lang < 'all' THEN lang || ',all' ELSE 'all,' || lang END AS tags,
  strftime(DATE '2024-01-01' + (c.doc_id % 365)::INT, '%Y-%m-%d') AS published_at, c.doc_id % 50 AS question_score, c.doc_id % 7 AS answers_count, c.doc_id % 2 = 0 AS accepted_answer, contains(c.text, '#') OR contains(s.text, '|') AS has_code,
  CASE WHEN ordinal = 0 THEN 'QUESTION' ELSE 'ANSWER' END AS section_type, '' AS language, status AS document_status, processing_status, deduplication_status, '{_INDEXED_AT}' AS indexed_at, '{_SCHEMA}' AS index_schema_version, substr(c.text, 1, 280) AS text_preview
  FROM chunks c JOIN states s ON s.doc_id = c.doc_id WHERE status IN ('ACTIVE', 'OUTDATED') AND processing_status = 'CHUNKED' AND deduplication_status = 'UNIQUE' AND processing_error IS NULL AND (c.doc_id + ordinal) % 19 <> 0 AND trim(c.text) <> '')"""


def _points(t: Tables):
    return C.payload(_states(t), _index_chunks(t), _INDEXED_AT, _SCHEMA)


@query(f"WITH {_POINTS} SELECT * FROM points")
def index_payload(t: Tables):
    """All fields of the points of eligible chunks."""
    return _points(t).withColumn("tags", F.array_join("tags", ",")).drop("contextual_text")


@query(
    f"""WITH {_POINTS}, n AS (SELECT count(*) AS points FROM points), e AS (SELECT count(*) AS entries FROM chunks WHERE (doc_id + ordinal) % 23 <> 0),
    shown AS (SELECT p.document_id::BIGINT AS doc_id, p.document_version FROM points p ORDER BY chunk_id LIMIT 100),
    stale AS (SELECT count(*) AS stale FROM shown JOIN states s USING (doc_id) WHERE NOT (s.version = shown.document_version)),
    listed AS (SELECT 'index_pointer' AS code, 1 AS actual, 1 AS expected UNION ALL SELECT 'collection_schema', 0, 1 UNION ALL SELECT 'point_count', points, points FROM n UNION ALL SELECT 'entry_count', entries, points FROM n, e
      UNION ALL SELECT 'manifest_point_count', 0, points FROM n UNION ALL SELECT 'hidden_points_absent', 0, 0 UNION ALL SELECT 'failed_points_absent', 0, 0 UNION ALL SELECT 'duplicate_points_absent', 0, 0 UNION ALL SELECT 'sample_payloads_current', stale, 0 FROM stale)
    SELECT code, actual::BIGINT AS actual, expected::BIGINT AS expected, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM listed"""
)
def index_consistency(t: Tables):
    """The nine checks of an index: its schema, manifest and entries are wrong here, the rest is right."""
    chunks = _index_chunks(t)
    entries = chunks.select("document_id", F.when((F.col("document_id") + F.col("ordinal")) % 23 == 0, "FAILED").otherwise("INDEXED").alias("status"))
    return C.index_checks(_points(t), entries, _states(t), chunks, manifest_points=0, pointer_right=True, schema_right=False)


@query(
    """WITH cur AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), inc AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
    firsts AS (SELECT h, min(doc_id) AS first_id FROM inc GROUP BY h)
    SELECT inc.doc_id, CASE WHEN first_id <> inc.doc_id THEN 'DUPLICATE' WHEN cur.h IS NULL THEN 'INSERTED' WHEN cur.h <> inc.h THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome
    FROM inc JOIN firsts USING (h) LEFT JOIN cur ON cur.doc_id = inc.doc_id"""
)
def upsert_outcomes(t: Tables):
    """What an ingestion did with each document; being another's duplicate is told before all else."""
    current = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("old"))
    incoming = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    rows = O.exact_duplicates(incoming, F.col("text"), F.col("doc_id") * 0, "doc_id").join(current, "doc_id", "left")
    return rows.select("doc_id", C.outcome(F.col("old"), F.col("content_hash"), F.col("duplicate_of")).alias("outcome"))


@query(
    """WITH c AS (SELECT event_type AS code, CASE WHEN count(*) FILTER (WHERE value > 1e9) > 0 THEN 'FAIL' WHEN max(value) > 99.5 THEN 'WARNING' WHEN event_type = 'signup' THEN 'NOT_RUN' ELSE 'PASS' END AS status, event_type <> 'signup' AS required FROM events GROUP BY event_type),
    o AS (SELECT 'all' AS checks, * FROM c UNION ALL SELECT 'required', * FROM c WHERE required UNION ALL SELECT 'strict', code, status, true FROM c)
    SELECT checks, CASE WHEN count(*) FILTER (WHERE required AND status IN ('FAIL', 'NOT_RUN')) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status IN ('WARNING', 'NOT_RUN')) > 0 THEN 'WARNING' ELSE 'PASS' END AS overall, count(*)::BIGINT AS n FROM o GROUP BY checks"""
)
def report_status(t: Tables):
    """The status of a report: warnings, and checks that were not run, required and not."""
    checks = t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 1e9).alias("bad"), F.max("value").alias("most"))
    status = F.when(F.col("bad") > 0, "FAIL").when(F.col("most") > 99.5, "WARNING").when(F.col("event_type") == "signup", "NOT_RUN").otherwise("PASS")
    rows = checks.select(F.col("event_type").alias("code"), status.alias("status"), (F.col("event_type") != "signup").alias("required"))
    named = lambda name, df: df.withColumn("checks", F.lit(name))
    every = named("all", rows).unionByName(named("required", rows.where("required"))).unionByName(named("strict", rows.withColumn("required", F.lit(True))))
    return every.groupBy("checks").agg(C.overall().alias("overall"), F.count("*").alias("n"))


@query(
    f"""WITH {_POINTS} SELECT chunk_id, document_id FROM points WHERE document_status IN ('ACTIVE', 'OUTDATED') AND processing_status = 'CHUNKED' AND deduplication_status = 'UNIQUE'
    AND (tags LIKE 'en,%' OR tags LIKE '%,en' OR tags LIKE 'fr,%' OR tags LIKE '%,fr') AND published_at BETWEEN '2024-02-01' AND '2024-10-31' AND question_score >= 10 AND accepted_answer AND section_type = 'ANSWER'"""
)
def search_filters_points(t: Tables):
    """Points by tags, dates, least score, accepted answer and section, of searchable documents."""
    filters = SearchFilters(tags=("en", "fr"), created=("2024-02-01", "2024-10-31"), least_score=10, accepted=True, section="ANSWER", searchable=True)
    names = {"tags": "tags", "created": "published_at", "score": "question_score", "accepted": "accepted_answer", "section": "section_type", "status": "document_status", "processing": "processing_status", "deduplication": "deduplication_status"}
    return _points(t).where(filters.column(names)).select("chunk_id", "document_id")
