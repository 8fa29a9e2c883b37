"""Lexical search by stems, and by an index that is kept up by deltas."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from siltstone.functions import stemming as M
from siltstone.operators import highlight, hyperplanes
from siltstone.operators import retrieval as R
from siltstone.plans.registry import Tables, query
from siltstone.sources import index
from siltstone.sources.lexical_index import LexicalIndex
from siltstone.sources.shared import new_folder

#: The tables hold no Russian, so their letters are read as Cyrillic ones.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyzäöüßéèàçê", "абцдефгхийклмнопярстувьхызеоусеиащы"


def cyrillic(text):
    return F.translate(F.lower(text), _LATIN, _CYRILLIC)


def _ending_sql(lists: tuple[str, str]) -> str:
    after, free = ("|".join(sorted(part.split(), key=len, reverse=True)) for part in lists)
    return f"(?:([ая])(?:{after})|(?:{free}))$" if after else f"(?:{free})$"


_V = M.VOWEL
#: Stems of (w) as DuckDB reads them, step by step.
_STEM_SQL = f"""
st0 AS (SELECT w, replace(w, 'ё', 'е') AS p FROM words),
st1 AS (SELECT *, regexp_extract(p, '^[^{_V}]*(?:[{_V}]|$)') AS start, regexp_extract(p, '^(?:.*?[{_V}][^{_V}]){{2}}') AS two FROM st0),
st2 AS (SELECT *, substr(p, length(start) + 1) AS rv, CASE WHEN two = '' THEN length(p) + 1 ELSE length(two) END AS r2 FROM st1),
st3 AS (SELECT *, regexp_replace(rv, '{_ending_sql(M.GERUND)}', '\\1') AS gerund, regexp_replace(rv, '{_ending_sql(M.REFLEXIVE)}', '') AS bare FROM st2),
st4 AS (SELECT *, regexp_replace(bare, '{_ending_sql(M.ADJECTIVE)}', '') AS adjective, regexp_replace(bare, '{_ending_sql(M.VERB)}', '\\1') AS verb FROM st3),
st5 AS (SELECT *, regexp_replace(CASE WHEN gerund <> rv THEN gerund WHEN adjective <> bare THEN regexp_replace(adjective, '{_ending_sql(M.PARTICIPLE)}', '\\1') WHEN verb <> bare THEN verb
  ELSE regexp_replace(bare, '{_ending_sql(M.NOUN)}', '') END, 'и$', '') AS two_off FROM st4),
st6 AS (SELECT *, CASE WHEN length(regexp_extract(two_off, 'ость?$')) > 0 AND length(start) + length(two_off) - length(regexp_extract(two_off, 'ость?$')) >= r2 THEN regexp_replace(two_off, 'ость?$', '') ELSE two_off END AS three_off FROM st5),
st7 AS (SELECT *, regexp_replace(three_off, 'ейше?$', '') AS superlative FROM st6),
stems AS (SELECT w, CASE WHEN NOT regexp_matches(w, '[а-яё]') THEN w ELSE start || CASE WHEN superlative <> three_off OR three_off LIKE '%нн' THEN regexp_replace(superlative, 'нн$', 'н') ELSE regexp_replace(three_off, 'ь$', '') END END AS term FROM st7)"""
_WORDS = rf"regexp_extract_all(translate(lower(text), '{_LATIN}', '{_CYRILLIC}'), '[\p{{L}}\p{{N}}_]+')"
_STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)
_STEMMED = f"""WITH told AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), asked AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark),
words AS (SELECT DISTINCT w FROM (SELECT w FROM told UNION SELECT w FROM asked) WHERE w NOT IN ({_STOP})), {_STEM_SQL.strip()},
terms AS (SELECT doc_id, term FROM told JOIN stems USING (w)), q AS (SELECT DISTINCT item_id, term FROM asked JOIN stems USING (w)),
dl AS (SELECT d.doc_id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1) USING (doc_id)),
post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM post JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id), size GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM scored) WHERE rank <= 60"""


@query(_STEMMED)
def bm25_stemmed(t: Tables):
    """BM25 by Russian stems without stop words, on texts and queries alike."""
    docs = t.documents.select("doc_id", cyrillic(F.col("text")).alias("text"))
    asked = t.benchmark.select("item_id", cyrillic(F.col("text")).alias("asked_text"))
    return R.bm25(docs, asked, "doc_id", "text", "item_id", "asked_text", 60, analyzer=M.russian_words, stem=M.russian_stem).select("item_id", "doc_id", "score", "rank")


_KEPT = "(SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


def _index_sql() -> str:
    from siltstone.plans.search_queries import _BM25

    return f"WITH {_BM25.strip()} SELECT item_id, doc_id, score, rank::BIGINT AS rank FROM bm".replace("SELECT doc_id FROM documents WHERE true", f"SELECT doc_id FROM {_KEPT}").replace("FROM documents)", f"FROM {_KEPT})")


@query(_index_sql())
def lexical_index_deltas(t: Tables):
    """The index after all texts were put in, some were changed and some deleted: as if built anew."""
    lexical = LexicalIndex(t.spark, new_folder(t.spark, "lexical"), buckets=8)
    docs = t.documents.select(F.col("doc_id").alias("key"), "text")
    lexical.update(1, docs)
    lexical.update(2, docs.where("key % 5 = 1").withColumn("text", F.reverse("text")), docs.where("key % 7 = 3").select("key"))
    return lexical.search(t.benchmark, "item_id", "text", 60).select("item_id", F.col("key").alias("doc_id"), "score", "rank")


@query()
def dense_topk_hyperplanes(t: Tables):
    """The nearest vectors by random hyperplanes instead of a scan; recall against the scan is a test."""
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("asked"))
    index = hyperplanes.build(t.spark, t.embeddings, "vec_id", 60)
    return hyperplanes.search(index, asked, "item_id", 60).select("item_id", F.col("key").alias("doc_id"), "score", "rank")


def _highlight_sql() -> str:
    from siltstone.plans.search_queries import _FUSED

    return rf"""{_FUSED}, longest AS (SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2)), lambda x: lpad(length(x)::VARCHAR, 5, '0') || x), 'DESC'), lambda x: substr(x, 6)), '|') AS p FROM benchmark)
SELECT f.item_id, f.doc_id, CASE WHEN p = '' THEN sha256(text) ELSE sha256(regexp_replace(text, '(?i)(' || p || ')', '<mark>\1</mark>', 'g')) END AS marked
FROM fused f JOIN longest USING (item_id) JOIN documents d ON f.doc_id = d.doc_id WHERE f.rank <= 10"""


@query(_highlight_sql())
def highlight_queries(t: Tables):
    """The texts of each query's first ten with that query's terms marked."""
    from siltstone.plans.search_queries import _fused

    path = new_folder(t.spark, "pairs")
    _fused(t).where("rank <= 10").join(t.documents.select("doc_id"), "doc_id", "left_semi").select("item_id", "doc_id").write.parquet(path)
    terms = F.filter(R.terms(F.col("text")), lambda x: F.length(x) > 2)
    spans = highlight.highlighted(t.spark.read.parquet(path), t.benchmark, t.documents, "item_id", "doc_id", terms, "text")
    return spans.join(t.documents.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", F.sha2(highlight.marked(F.col("text"), F.col("spans")), 256).alias("marked"))


@query(
    """SELECT 1::BIGINT AS version, 'RETIRED' AS status, NULL::VARCHAR AS code, count(*) FILTER (WHERE vec_id % 2 = 0)::BIGINT AS points, false AS served FROM embeddings UNION ALL
    SELECT 2, 'ACTIVE', NULL, count(*)::BIGINT, true FROM embeddings UNION ALL SELECT 3, 'FAILED', 'INDEX_POINT_COUNT_MISMATCH', NULL, false"""
)
def index_publish(t: Tables):
    """Two versions of an index published one after the other, and one that its checks refuse."""
    versions = index.IndexVersions(t.spark, new_folder(t.spark, "index"), dimensions=64)
    points = t.embeddings.select(F.col("vec_id").cast("string").alias("point_id"), F.col("vec_id").alias("document_id"), "embedding")
    for version, rows in ((1, points.where("document_id % 2 = 0")), (2, points)):
        versions.build(rows, version)
        versions.activate(version)
    with contextlib.suppress(index.IndexFailure):
        versions.build(points.withColumn("point_id", F.lit("same")), 3)
    _, active = versions.pointer()
    told = [(v, versions.status(v), versions.history(v)[-1].get("code"), next((h["points"] for h in versions.history(v) if "points" in h), None), v == active) for v in versions.versions()]
    return t.spark.createDataFrame(told, "version bigint, status string, code string, points bigint, served boolean")
