"""Answer context and evaluation; a document is relevant to a benchmark text that it contains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation as E
from siltstone.operators import rag as G
from siltstone.operators import retrieval as R
from siltstone.plans.registry import Tables, query
from siltstone.plans.search_queries import _BM25, _FUSED, _bm25, _dense, _final, _fused
from siltstone.sources.shared import kept

_EST = "greatest(1, (length(text) + 3) // 4)"
_REL = "rel AS (SELECT item_id, doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text))"


def _relevant(t: Tables):
    """(item_id, doc_id) of the items and the texts that contain them, written once, and a row without a document for each item."""
    pairs = R.containing(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")
    return kept(t.benchmark.select("item_id", F.lit(None).cast("bigint").alias("doc_id")).unionByName(pairs), "relevant")


def _context(t: Tables):
    rows = _final(t).where("rank <= 12").select("item_id", F.struct("rank", F.col("doc_id").alias("id"), T.token_estimate(F.col("text")).alias("n"), "text").alias("p"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))


_PACK = f"""{_FUSED},
listed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS i, doc_id, {_EST} AS n FROM final WHERE rank <= 12),
walk AS (
  SELECT item_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS taken, NULL::BIGINT AS doc_id, NULL::BIGINT AS n, NULL::BOOLEAN AS cut FROM (SELECT DISTINCT item_id FROM listed)
  UNION ALL
  SELECT w.item_id, l.i, CASE WHEN ok THEN used + m ELSE used END, CASE WHEN ok THEN taken + 1 ELSE taken END, CASE WHEN ok THEN l.doc_id END, m, l.n > 2000 - used
  FROM walk w JOIN listed l ON l.item_id = w.item_id AND l.i = w.i + 1, LATERAL (SELECT (taken < 6 AND (l.n <= 2000 - used OR 2000 - used >= 40)) AS ok, least(l.n, 2000 - used) AS m))
SELECT item_id, doc_id, n, cut FROM walk WHERE doc_id IS NOT NULL"""


@query(_PACK.replace("WITH ", "WITH RECURSIVE ", 1))
def context_pack(t: Tables):
    packed = _context(t).select("item_id", F.explode(G.pack_context(F.col("ps"), 2000, 40, 6)).alias("c"))
    return packed.select("item_id", F.col("c.id").alias("doc_id"), F.col("c.n").alias("n"), F.col("c.cut").alias("cut"))


@query(f"""{_FUSED.replace('WITH ', 'WITH RECURSIVE ', 1)},
listed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS i, doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS x FROM final WHERE rank <= 12),
walk AS (
  SELECT item_id, 1::BIGINT AS i, [doc_id] AS ids, [x] AS xs FROM listed WHERE i = 1
  UNION ALL
  SELECT w.item_id, l.i, CASE WHEN rep THEN ids ELSE list_append(ids, l.doc_id) END, CASE WHEN rep THEN xs ELSE list_append(xs, l.x) END
  FROM walk w JOIN listed l ON l.item_id = w.item_id AND l.i = w.i + 1, LATERAL (SELECT len(list_filter(xs, lambda y: y = l.x OR (length(y) >= 80 AND contains(l.x, y)) OR (length(l.x) >= 80 AND contains(y, l.x)))) > 0 AS rep))
SELECT item_id, array_to_string(arg_max(ids, i), ',') AS ids FROM walk GROUP BY item_id""")
def overlap_dedup(t: Tables):
    alone = _context(t).select("item_id", G.drop_contained(F.col("ps"), 80).alias("kept"))
    return alone.select("item_id", F.array_join(F.transform("kept", lambda p: p["id"].cast("string")), ",").alias("ids"))


def _answers(t: Tables):
    """Per item: best and mean relevance and sources of the rerank window, and a count cited."""
    return _final(t).where("place <= 8").groupBy("item_id").agg(F.max("reranked").alias("top"), F.round(F.avg("reranked"), 6).alias("mean"), F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens")).withColumn("cited", F.col("item_id") % 4)


_ANSWERS = f"""{_FUSED}, answers AS (
  SELECT item_id, max(reranked) AS top, round(avg(reranked), 6) AS mean, count(*) AS n, sum({_EST})::BIGINT AS tokens, item_id % 4 AS cited FROM final WHERE place <= 8 GROUP BY item_id)"""


@query(f"""{_ANSWERS}, scored AS (SELECT item_id, CASE WHEN n >= 3 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE * top + 0.25::DOUBLE * mean + 0.15::DOUBLE * least(1.0::DOUBLE, n / 3) + 0.15::DOUBLE * least(1.0::DOUBLE, cited / greatest(n, 1)))), 3) ELSE 0.1::DOUBLE END AS score FROM answers)
SELECT item_id, score, CASE WHEN score >= 0.72 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scored""")
def confidence(t: Tables):
    score, level = G.confidence(F.col("top"), F.col("mean"), F.col("n"), F.col("cited"), F.col("n") >= 3)
    return _answers(t).select("item_id", score.alias("score"), level.alias("level"))


@query(f"{_ANSWERS} SELECT item_id, CASE WHEN n < 1 THEN 'NO_SOURCES' WHEN tokens < 40 THEN 'FEW_TOKENS' WHEN coalesce(top, 0) < 0.25 THEN 'WEAK' ELSE 'OK' END AS gate, CASE WHEN n < 1 THEN 'NO_SOURCES' WHEN tokens < 3000 THEN 'FEW_TOKENS' WHEN coalesce(top, 0) < 0.9 THEN 'WEAK' ELSE 'OK' END AS strict FROM answers")
def insufficient_context(t: Tables):
    """The gate with its defaults, and with thresholds that more contexts fail."""
    n, tokens, top = F.col("n"), F.col("tokens"), F.col("top")
    return _answers(t).select("item_id", G.context_gate(n, tokens, top).alias("gate"), G.context_gate(n, tokens, top, 1, 3000, 0.9).alias("strict"))


@query("""
WITH a AS (SELECT event_id, event_type || user_id AS k, (value > 50) AS body, ts FROM events WHERE event_id > 300), r AS (SELECT event_type || user_id AS k, max(value > 50) AS known FROM events WHERE event_id <= 300 GROUP BY 1),
j AS (SELECT a.*, known, row_number() OVER (PARTITION BY k ORDER BY event_id) AS place, first_value(body) OVER (PARTITION BY k ORDER BY event_id) AS first FROM a LEFT JOIN r USING (k))
SELECT event_id, CASE WHEN coalesce(known, first) <> body THEN 'CONFLICT' WHEN known IS NOT NULL THEN 'REPLAY' WHEN place = 1 THEN 'NEW' ELSE 'REPEAT' END AS outcome FROM j""")
def idempotent_ask(t: Tables):
    rows = t.events.select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("k"), (F.col("value") > 50).alias("body"))
    runs = rows.where("event_id <= 300").groupBy("k").agg(F.max("body").alias("body"))
    return G.ask_once(runs, rows.where("event_id > 300"), "k", "body", [F.col("event_id")]).select("event_id", "outcome")


@query()
def context_texts(t: Tables):
    """Whole contexts; a golden and a plain Python version hold the rules."""
    from siltstone.operators import retrieval as R

    found = _final(t, lists=_fused(t))
    listed = found.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), "text"))).alias("ps"))  # 80 passages at most
    whole = listed.select("item_id", F.explode(F.transform(G.drop_contained(F.col("ps"), 80), lambda p: p["id"])).alias("doc_id"))
    rows = R.group_by(found.join(whole, ["item_id", "doc_id"], "left_semi"), "item_id", "source", "rank", 2).where("group_rank <= 12")
    passage = F.struct("group_rank", "in_group", F.col("doc_id").alias("id"), F.col("source").alias("title"), T.strip(F.col("text")).alias("text")).alias("p")
    groups = rows.select("item_id", "group_rank", passage).groupBy("item_id", "group_rank").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    joined = groups.select("item_id", F.struct("group_rank", F.col("ps")[0]["id"].alias("id"), F.col("ps")[0]["title"].alias("title"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text")).alias("g"))
    built = joined.groupBy("item_id").agg(G.context_text(F.sort_array(F.collect_list("g"))).alias("c"))
    return built.select("item_id", F.sha2("c.text", 256).alias("digest"), F.col("c.tokens").alias("tokens"), F.to_json("c.sources").alias("sources"))


@query(f"{_FUSED} SELECT item_id, doc_id, substr(text, 1, 700) AS shown, CASE WHEN reranked IS NULL OR reranked = 0 THEN fusion ELSE reranked END AS score FROM final WHERE rank <= 20")
def source_projection(t: Tables):
    return _final(t).where("rank <= 20").select("item_id", "doc_id", F.substring("text", 1, 700).alias("shown"), F.when(F.col("reranked").isNull() | (F.col("reranked") == 0), F.col("fusion")).otherwise(F.col("reranked")).alias("score"))


@query("""SELECT event_type, count(*)::BIGINT AS total, round(count(*) FILTER (WHERE value > 50) / count(*), 3) AS valid_rate, round(count(*) FILTER (WHERE user_id % 9 = 0) / count(*), 3) AS refused_rate, round(avg(value) FILTER (WHERE value > 50), 9) AS avg_ms FROM events GROUP BY event_type""")
def rag_diagnostics(t: Tables):
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    return t.events.groupBy("event_type").agg(F.count("*").alias("total"), rate(F.col("value") > 50).alias("valid_rate"), rate(F.col("user_id") % 9 == 0).alias("refused_rate"), F.round(F.avg(F.when(F.col("value") > 50, F.col("value"))), 9).alias("avg_ms"))


_MEASURE = """SELECT n.item_id, CASE WHEN n > 0 THEN round(coalesce(hits, 0) / n, 6) ELSE 0 END AS recall, (coalesce(hits, 0) > 0)::BIGINT AS hit, coalesce(round(1 / first, 6), 0) AS mrr,
  CASE WHEN n > 0 THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda r: 1 / log2(r + 1))), 6) ELSE 0 END AS ndcg
FROM (SELECT item_id, count(doc_id) AS n FROM rel GROUP BY item_id) n LEFT JOIN (SELECT r.item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM {ranked} r JOIN rel USING (item_id, doc_id) WHERE rank <= {k} GROUP BY r.item_id) h ON n.item_id = h.item_id"""


@query(f"WITH {_BM25.strip()}, {_REL} {_MEASURE.format(k=10, ranked='bm')}")
def ranking_measures_at_10(t: Tables):
    return E.ranking_measures(_bm25(t), _relevant(t), "item_id", "doc_id", 10)


@query(f"WITH {_BM25.strip()}, {_REL} SELECT round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit_rate FROM ({_MEASURE.format(k=5, ranked='bm')})")
def recall_at_5(t: Tables):
    return E.ranking_measures(_bm25(t), _relevant(t), "item_id", "doc_id", 5).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query(f"""{_FUSED}, {_REL}, reranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS rank FROM final), modes AS (SELECT 'bm25' AS mode, * FROM ({_MEASURE.format(k=10, ranked='bm')}) UNION ALL SELECT 'vector', * FROM ({_MEASURE.format(k=10, ranked='de')}) UNION ALL SELECT 'hybrid', * FROM ({_MEASURE.format(k=10, ranked='fused')}) UNION ALL SELECT 'hybrid+reranker', * FROM ({_MEASURE.format(k=10, ranked='reranked')}))
SELECT mode, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM modes GROUP BY mode""")
def mode_comparison(t: Tables):
    relevant, lexical, near = _relevant(t), kept(_bm25(t), "lexical"), kept(_dense(t), "near")
    fused = kept(R.fuse(lexical, near, "item_id", "doc_id", 80), "fused")
    reranked = _final(t, lists=fused).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("final"), "doc_id")))
    modes = (("bm25", lexical), ("vector", near), ("hybrid", fused), ("hybrid+reranker", reranked))
    rows = [E.ranking_measures(ranked, relevant, "item_id", "doc_id", 10).withColumn("mode", F.lit(mode)) for mode, ranked in modes]
    return reduce(DataFrame.unionByName, rows).groupBy("mode").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[round_even((count(value) - 1) * 0.95, 0)::INT + 1] AS p95_rounded FROM events GROUP BY event_type""")
def latency_percentiles(t: Tables):
    return E.quantiles(t.events, "event_type", "value", {"p50": E.nearest_rank(0.5), "p95": E.nearest_rank(0.95), "p95_rounded": E.rounded_index(0.95)})


@query("""
WITH r AS (SELECT conv_id, coalesce(list(DISTINCT turn) FILTER (WHERE role = 'user'), []) AS expected, coalesce(list(DISTINCT turn + 1) FILTER (WHERE role = 'user' OR turn % 3 = 0), []) AS returned, bool_or(role = 'system') AS refuse,
  string_agg(text, E'\\n' ORDER BY turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id),
p AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN [] ELSE ['The', 'und', 'zz' || conv_id] END AS points FROM r)
SELECT conv_id, CASE WHEN len(expected) = 0 THEN (len(returned) = 0)::INT::DOUBLE ELSE round(len(list_intersect(expected, returned)) / len(expected), 6) END AS source_recall, (conv_id % 4 <> 0)::INT::DOUBLE AS citation_validity,
  CASE WHEN len(points) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(points, lambda x: contains(lower(coalesce(answer, '')), lower(x)))) / len(points), 6) END AS key_point_coverage, (refuse = (len(returned) > 3))::INT::DOUBLE AS refusal_right FROM p""")
def rag_eval(t: Tables):
    user = F.col("role") == "user"
    said = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    rows = t.conversations.groupBy("conv_id").agg(F.collect_set(F.when(user, F.col("turn"))).alias("expected"), F.collect_set(F.when(user | (F.col("turn") % 3 == 0), F.col("turn") + 1)).alias("returned"), F.bool_or(F.col("role") == "system").alias("refuse"), F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("answer"))
    points = F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("The"), F.lit("und"), F.concat(F.lit("zz"), F.col("conv_id").cast("string"))))
    measures = G.answer_measures(F.col("expected"), F.col("returned"), points, F.col("answer"), F.col("conv_id") % 4 != 0, F.col("refuse"), F.size("returned") > 3)
    return rows.select("conv_id", *(m.alias(k) for k, m in measures.items()))


@query("SELECT sha256(string_agg(h, E'\\n' ORDER BY block)) AS digest FROM (SELECT item_id // 10000 AS block, sha256(string_agg(sha256(item_id || ':' || text), E'\\n' ORDER BY item_id)) AS h FROM benchmark GROUP BY 1)")
def dataset_hash(t: Tables):
    """An ordered hash of lines by blocks of 10,000 ids, so that no group is without bound; then of the blocks."""
    lines = t.benchmark.select("item_id", F.sha2(F.concat_ws(":", F.col("item_id").cast("string"), "text"), 256).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"), 256)
    blocks = lines.groupBy(F.floor(F.col("item_id") / 10_000).alias("block")).agg(joined("item_id").alias("h"))
    return blocks.agg(joined("block").alias("digest"))
