"""Chunking and retrieval: documents answer benchmark texts, embeddings answer the vector of the same id."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, retrieval as R
from siltstone.operators.filters import SearchFilters
from siltstone.plans.registry import Tables, query
from siltstone.sources.shared import kept

_TOKENS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"


def _chunks(t: Tables):
    rows = t.documents.select("doc_id", chunking.blocks(F.col("text")).alias("blocks"))
    packed = rows.select("doc_id", "blocks", F.posexplode(chunking.pack(F.col("blocks"), 120, 180, 20)).alias("ordinal", "c"))
    text = F.array_join(F.transform(F.slice("blocks", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1), lambda b: b["text"]), "\n")
    return packed.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("c.n").cast("bigint").alias("n_tokens"), text.alias("text"))


_FOLD = rf"""
WITH RECURSIVE line AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, x, len(regexp_extract_all(x, {_TOKENS})) AS n FROM (
    SELECT doc_id, generate_subscripts(string_split(text, E'\n'), 1) AS j, unnest(string_split(text, E'\n')) AS x FROM documents) WHERE trim(x) <> ''),
fold AS (
  SELECT doc_id, 0 AS i, [] :: STRUCT(a BIGINT, b BIGINT, n BIGINT)[] AS done, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS n FROM documents
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN (x_n IS NULL OR (n > 0 AND n + x_n > 120)) AND n > 0 THEN
      CASE WHEN len(done) > 0 AND n < 20 AND done[len(done)].n + n <= 180 THEN list_concat(done[1:len(done) - 1], [{{'a': done[len(done)].a, 'b': b, 'n': done[len(done)].n + n}}])
      ELSE list_concat(done, [{{'a': a, 'b': b, 'n': n}}]) END ELSE done END,
    CASE WHEN n = 0 OR n + x_n > 120 THEN i ELSE a END, i, CASE WHEN x_n IS NULL THEN -1 WHEN n = 0 OR n + x_n > 120 THEN x_n ELSE n + x_n END
  FROM (SELECT f.*, l.n AS x_n FROM fold f LEFT JOIN line l ON l.doc_id = f.doc_id AND l.i = f.i) WHERE n >= 0),
packed AS (SELECT doc_id, generate_subscripts(done, 1) - 1 AS ordinal, unnest(done) AS c FROM fold WHERE n = -1)
SELECT p.doc_id, ordinal::BIGINT AS ordinal, any_value(c.n)::BIGINT AS n_tokens, string_agg(x, E'\n' ORDER BY i) AS text FROM packed p JOIN line l ON l.doc_id = p.doc_id AND l.i BETWEEN c.a AND c.b GROUP BY p.doc_id, ordinal"""


@query(f"SELECT doc_id, ordinal, n_tokens, sha256(text) AS digest FROM ({_FOLD})")
def chunk_pack(t: Tables):
    return _chunks(t).select("doc_id", "ordinal", "n_tokens", F.sha2("text", 256).alias("digest"))


@query(f"""SELECT c.doc_id, ordinal, sha256(c.doc_id || ':1:' || ordinal || ':' || sha256(c.text)) AS chunk_key, length(c.text)::BIGINT AS n_chars, sha256(source || ' > ' || lang || E'\\n' || c.text) AS contextual_text,
  contains(c.text, '|') AS has_code, substr(c.text, 1, 280) AS preview FROM ({_FOLD}) c JOIN documents d ON c.doc_id = d.doc_id WHERE trim(c.text) <> '' AND source <> 'src5'""")
def chunk_assembly(t: Tables):
    """Chunks of eligible documents with keys, context and payload."""
    rows = _chunks(t).join(t.documents.where("source <> 'src5'").select("doc_id", "source", "lang"), "doc_id").where("trim(text) <> ''")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("1"), F.col("ordinal").cast("string"), F.sha2("text", 256))
    context = F.concat("source", F.lit(" > "), "lang", F.lit("\n"), "text")
    return rows.select("doc_id", "ordinal", F.sha2(key, 256).alias("chunk_key"), F.length("text").cast("bigint").alias("n_chars"), F.sha2(context, 256).alias("contextual_text"), F.contains("text", F.lit("|")).alias("has_code"), F.substring("text", 1, 280).alias("preview"))


@query("""SELECT doc_id, (i - 1)::BIGINT AS piece, sha256(array_to_string(toks[(i - 1) * 200 + 1 : i * 200], ' ')) AS digest FROM (
  SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS toks, unnest(range(1, (len(toks) + 199) // 200 + 1)) AS i FROM documents)""")
def oversize_split(t: Tables):
    """Pieces of 200 tokens."""
    rows = t.documents.select("doc_id", T.tokens(F.col("text")).alias("toks")).where("size(toks) > 0")
    cut = rows.select("doc_id", "toks", F.explode(F.sequence(F.lit(0), F.floor((F.size("toks") - 1) / 200).cast("int"))).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.sha2(F.array_join(F.slice("toks", F.col("piece") * 200 + 1, 200), " "), 256).alias("digest"))


@query(r"""SELECT item_id, CASE WHEN length(q) = 0 THEN 'EMPTY' WHEN length(q) > 400 THEN 'TOO_LONG' WHEN (length(q) + 3) // 4 > 90 THEN 'TOO_MANY_TOKENS' ELSE 'OK' END AS verdict, q FROM (
  SELECT item_id, trim(regexp_replace('  ' || text || E'\r\n', '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM benchmark)""")
def query_normalize(t: Tables):
    q = F.trim(F.regexp_replace(F.concat(F.lit("  "), "text", F.lit("\r\n")), r"[ \t\n\x0B\f\r]+", " "))
    verdict = F.when(F.length("q") == 0, "EMPTY").when(F.length("q") > 400, "TOO_LONG").when(T.token_estimate(F.col("q")) > 90, "TOO_MANY_TOKENS").otherwise("OK")
    return t.benchmark.select("item_id", q.alias("q")).select("item_id", verdict.alias("verdict"), "q")


_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = f"""
bm_list AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
bm_post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM bm_list) GROUP BY ALL),
bm_df AS (SELECT term, count(*) AS df FROM bm_post GROUP BY term),
bm_size AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM bm_list),
bm_q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
bm_scored AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM (SELECT * FROM bm_post WHERE doc_id IN (SELECT doc_id FROM documents WHERE true)) JOIN bm_df USING (term) JOIN bm_q USING (term), bm_size GROUP BY item_id, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm_scored) WHERE rank <= 60)"""
_DENSE = """
de_scored AS (
  SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM (SELECT * FROM embeddings WHERE true) v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM de_scored) WHERE rank <= 60)"""
_FUSED = f"""WITH {_BM25.strip()}, {_DENSE.strip()},
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fusion DESC, least(rank_a, rank_b), doc_id) AS rank FROM (
    SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS rank_a, b.rank AS rank_b, a.score AS score_a, b.score AS score_b,
      round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 10) AS fusion
    FROM bm a FULL JOIN de b ON a.item_id = b.item_id AND a.doc_id = b.doc_id)) WHERE rank <= 80),
seen AS (SELECT f.*, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place, lang, source, n_chars, text FROM fused f JOIN documents d ON f.doc_id = d.doc_id WHERE source NOT IN ('src5', 'src9')),
overlap AS (SELECT s.*, CASE WHEN place <= 8 THEN round(len(list_filter(qt, lambda x: contains(lower(s.text), x))) / len(qt), 6) END AS reranked
  FROM seen s JOIN (SELECT item_id, list_distinct({_TERMS}) AS qt FROM benchmark) USING (item_id)),
final AS (SELECT *, round(CASE WHEN reranked IS NOT NULL THEN reranked * (1 - 0.15::DOUBLE) + fusion / max(fusion) OVER (PARTITION BY item_id) * 0.15::DOUBLE ELSE fusion / max(fusion) OVER (PARTITION BY item_id) END, 8) AS final FROM overlap)"""


#: The SQL of a search among the documents that satisfy a filter, which it takes before the cuts.
def fused_where(condition: str) -> str:
    return _FUSED.replace("FROM documents WHERE true", f"FROM documents WHERE {condition}").replace("FROM embeddings WHERE true", f"FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE {condition})")


def _names() -> dict:
    return {"language": "lang", "tags": F.array("lang"), "source": "source", "created": "doc_id", "chars": "n_chars", "code": F.contains("text", F.lit("|"))}


def _bm25(t: Tables, filters: SearchFilters | None = None):
    where = None if filters is None else filters.column(_names())
    return R.bm25(t.documents, t.benchmark.withColumnRenamed("text", "asked_text"), "doc_id", "text", "item_id", "asked_text", 60, where)


def _dense(t: Tables, filters: SearchFilters | None = None):
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("asked"))
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    if filters is not None:
        vectors = vectors.join(t.documents.where(filters.column(_names())).select("doc_id"), "doc_id", "left_semi")
    return R.cosine(vectors, asked, "doc_id", "item_id", 60)


def _fused(t: Tables, filters: SearchFilters | None = None):
    """The fused lists: 80 rows a query at most, written once."""
    return kept(R.fuse(_bm25(t, filters), _dense(t, filters), "item_id", "doc_id", 80), "fused")


def _seen(t: Tables, filters: SearchFilters | None = None, lists=None):
    visible = t.documents.where(~F.col("source").isin("src5", "src9"))
    return R.with_place(R.documents_of(_fused(t, filters) if lists is None else lists, visible, "doc_id"), "item_id")


def _final(t: Tables, filters: SearchFilters | None = None, lists=None):
    """Fused lists (``lists``, if they are known) with places, documents and final scores."""
    asked = t.benchmark.select("item_id", F.array_distinct(R.terms(F.col("text"))).alias("qt"))
    share = F.size(F.filter("qt", lambda x: F.contains(F.lower(F.col("text")), x))) / F.size("qt")
    rows = _seen(t, filters, lists).join(asked, "item_id").withColumn("reranked", F.when(F.col("place") <= 8, F.round(share, 6)))
    return R.blend(rows, "item_id", "doc_id", F.col("reranked"))


@query(f"WITH {_BM25.strip()} SELECT item_id, doc_id, score, rank::BIGINT AS rank FROM bm")
def bm25_topk(t: Tables):
    return _bm25(t).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {_DENSE.strip()} SELECT item_id, doc_id, score, rank::BIGINT AS rank FROM de")
def dense_topk(t: Tables):
    return _dense(t).select("item_id", "doc_id", "score", "rank")


@query(f"{_FUSED} SELECT item_id, f.doc_id, fusion, rank_a, rank_b, f.rank::BIGINT AS rank, source FROM fused f LEFT JOIN documents d ON f.doc_id = d.doc_id WHERE f.rank <= 10")
def hybrid_rrf(t: Tables):
    """The flagship: lexical and vector top lists fused, with document attributes."""
    top = _fused(t).where("rank <= 10")
    return R.documents_of(top, t.documents.select("doc_id", "source"), "doc_id", "left").select("item_id", "doc_id", "fusion", "rank_a", "rank_b", "rank", "source")


@query(f"{_FUSED} SELECT item_id, count(*)::BIGINT AS kept, (max(n) - count(*))::BIGINT AS stale FROM seen JOIN (SELECT item_id, count(*) AS n FROM fused GROUP BY 1) USING (item_id) GROUP BY item_id")
def hydrate_visible(t: Tables):
    """What is left of each fused list once hidden and deleted documents are gone."""
    visible = t.documents.where(~F.col("source").isin("src5", "src9")).select("doc_id", F.lit(1).alias("visible"))
    rows = R.documents_of(_fused(t), visible, "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("visible").alias("kept"))
    return rows.where("kept > 0").select("item_id", "kept", (F.col("n") - F.col("kept")).alias("stale"))


@query(f"{_FUSED} SELECT item_id, doc_id, place::BIGINT AS place, reranked FROM overlap WHERE place <= 8")
def rerank_window(t: Tables):
    return _final(t).where("place <= 8").select("item_id", "doc_id", "place", "reranked")


@query(f"{_FUSED} SELECT item_id, doc_id, final FROM final")
def final_scores(t: Tables):
    return _final(t).select("item_id", "doc_id", "final")


@query(f"""{_FUSED} SELECT item_id, source, doc_id, in_group::BIGINT AS in_group, dense_rank() OVER (PARTITION BY item_id ORDER BY first)::BIGINT AS group_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS in_group, min(rank) OVER (PARTITION BY item_id, source) AS first FROM seen) WHERE in_group <= 2""")
def group_by_document(t: Tables):
    return R.group_by(_seen(t), "item_id", "source", "rank", 2).select("item_id", "source", "doc_id", "in_group", "group_rank")


@query(f"""{_FUSED} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id)::BIGINT AS by_relevance, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC)::BIGINT AS by_date, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id)::BIGINT AS by_score FROM final""")
def sort_modes(t: Tables):
    from pyspark.sql import Window

    by = lambda *o: F.row_number().over(Window.partitionBy("item_id").orderBy(*o)).cast("bigint")
    return _final(t).select("item_id", "doc_id", by(F.desc("final"), "doc_id").alias("by_relevance"), by(F.desc("doc_id")).alias("by_date"), by(F.desc("n_chars"), "doc_id").alias("by_score"))


@query(f"""{_FUSED}, g AS (SELECT item_id, source, max(final) AS relevance, max(doc_id) AS date, max(n_chars) AS score FROM final GROUP BY ALL)
SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, source)::BIGINT AS by_relevance, row_number() OVER (PARTITION BY item_id ORDER BY date DESC, source)::BIGINT AS by_date,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source)::BIGINT AS by_score FROM g""")
def sort_group_modes(t: Tables):
    """The groups of each result in each of the orders that a user may choose."""
    return R.sort_groups(_final(t), "item_id", "source", {"relevance": F.col("final"), "date": F.col("doc_id"), "score": F.col("n_chars")})


@query(f"""{_FUSED} SELECT item_id, doc_id, final, place::BIGINT AS place, total::BIGINT AS total FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS place, count(*) OVER (PARTITION BY item_id) AS total FROM final) WHERE place BETWEEN 11 AND 20""")
def paginate(t: Tables):
    return R.page(_final(t), "item_id", [F.desc("final"), F.col("doc_id")], 2, 10).select("item_id", "doc_id", "final", "place", "total")


@query(f"""{_FUSED} SELECT item_id, f.doc_id, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'click' AND e.event_id % 1000 = f.doc_id) AS saved FROM final f WHERE f.rank <= 20""")
def saved_flag(t: Tables):
    saved = t.events.where("event_type = 'click'").select((F.col("event_id") % 1000).alias("doc_id")).distinct().withColumn("saved", F.lit(True))
    return _final(t).where("rank <= 20").join(saved, "doc_id", "left").select("item_id", "doc_id", F.coalesce("saved", F.lit(False)).alias("saved"))


@query("""SELECT doc_id FROM documents WHERE source NOT IN ('src5', 'src9') AND lang IN ('en', 'fr') AND doc_id BETWEEN 100 AND 800 AND n_chars >= 500 AND NOT contains(text, '|')""")
def search_filters(t: Tables):
    filters = SearchFilters(tags=("en", "fr"), hidden_sources=("src5", "src9"), created=(100, 800), least_chars=500, has_code=False)
    return t.documents.where(filters.column(_names())).select("doc_id")


@query(rf"""{_FUSED}
SELECT item_id, doc_id, round(0.68::DOUBLE * (len(list_filter(qt, lambda x: contains(lower(d.text), x))) / greatest(len(qt), 1)) + 0.32::DOUBLE * (len(list_filter(qt, lambda x: contains(lower(split_part(d.text, E'\n', 1)), x))) / greatest(len(qt), 1)), 6) AS overlap
FROM seen d JOIN (SELECT item_id, list_distinct(list_filter({_TERMS}, lambda x: length(x) > 1)) AS qt FROM benchmark) q USING (item_id)""")
def lexical_overlap(t: Tables):
    """The lexical scorer over every candidate that is left of each query; a title is a text's first line."""
    asked = t.benchmark.select("item_id", F.array_distinct(F.filter(R.terms(F.col("text")), lambda x: F.length(x) > 1)).alias("qt"))
    return _seen(t).join(asked, "item_id").select("item_id", "doc_id", F.round(R.lexical_overlap(F.col("qt"), F.col("text"), F.substring_index("text", "\n", 1)), 6).alias("overlap"))


@query("""SELECT vec_id, label, version FROM (SELECT vec_id, label, 1::BIGINT AS version FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id % 4 <> 0 UNION ALL SELECT vec_id, label + 1, 2 FROM embeddings WHERE vec_id % 4 = 0)""")
def index_upsert(t: Tables):
    """Points written again replace those with the same id; points of deleted documents go."""
    old = t.embeddings.where("vec_id % 10 <> 3").select("vec_id", "label", F.lit(1).cast("bigint").alias("version"))
    new = t.embeddings.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 1).alias("label"), F.lit(2).cast("bigint").alias("version"))
    return old.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)
