"""Text functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import variants as V
from siltstone.plans.registry import Tables, query

_STRIP = r"'^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'"


@query(rf"""
SELECT doc_id, length(t)::BIGINT AS n, sha256(t) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || E' \n\n \n\t end  ', '\r\n?', E'\n', 'g'), '[ \t\f\x0B\x{{A0}}]+', ' ', 'g'), ' ?\n ?', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), {_STRIP}) AS t
  FROM documents)""")
def normalize_text(t: Tables):
    out = t.documents.select("doc_id", T.normalize_text(F.concat("text", F.lit(" \n\n \n\t end  "))).alias("t"))
    return out.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("digest"))


@query(r"""
WITH parts AS (
  SELECT page_id, u, regexp_extract(u, '^([A-Za-z]+)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) AS p
  FROM (SELECT page_id, CASE WHEN contains(url, '?') THEN url || '&z=%41+b&Z&a=~*%2F' ELSE replace(url, '://', '://me@') || '?b=2&b=1' END AS u FROM pages)),
pairs AS (
  SELECT page_id, u, p, list_sort(list_filter(list_transform(list_filter(string_split(p.query, '&'), lambda x: x <> ''),
    lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=?(.*)$', 1), '+', ' '))}),
    lambda x: lower(x.k) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref'))) AS q FROM parts)
SELECT page_id, CASE WHEN regexp_matches(u, '^(?i:https?)://[^/?#]+') THEN
  lower(p.scheme) || '://' || lower(p.host) || CASE WHEN rtrim(p.path, '/') = '' THEN '/' ELSE rtrim(p.path, '/') END ||
  CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(q, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') END END AS url
FROM pairs""")
def url_normalize(t: Tables):
    """Addresses as they are, with parameters to decode, sort and encode, or with a user name."""
    u = F.when(F.contains("url", F.lit("?")), F.concat("url", F.lit("&z=%41+b&Z&a=~*%2F"))).otherwise(F.concat(F.replace("url", F.lit("://"), F.lit("://me@")), F.lit("?b=2&b=1")))
    return t.pages.select("page_id", T.normalize_url(u).alias("url"))


@query("SELECT page_id, (regexp_matches(url, '^(?i:https?)://[^/?#]+') AND page_id % 7 <> 0) AS safe FROM pages")
def safe_urls(t: Tables):
    broken = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return t.pages.select("page_id", T.is_safe_url(broken).alias("safe"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' STRASSE STRAßE ' || p_type, ' '), lambda x: substr(replace(lower(nfc_normalize(trim(x))), 'ß', 'ss'), 1, 100)), lambda x: x <> ''))), ',') AS tags FROM part""")
def tags_normalize(t: Tables):
    return t.part.select("p_partkey", F.array_join(T.normalize_tags(F.split(F.concat_ws(" ", "p_name", F.lit("STRASSE STRAßE"), "p_type"), " ")), ",").alias("tags"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_extract_all('<' || replace(p_type, ' ', '>< ') || '>< >', '<([^<>]+)>', 1), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part")
def tag_string_parse(t: Tables):
    packed = F.concat(F.lit("<"), F.replace("p_type", F.lit(" "), F.lit(">< ")), F.lit(">< >"))
    return t.part.select("p_partkey", F.array_join(T.tag_list(packed), "|").alias("tags"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS n_tokens, greatest(1, (length(text) + 3) // 4)::BIGINT AS estimate FROM documents")
def token_counts(t: Tables):
    return t.documents.select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), T.token_estimate(F.col("text")).alias("estimate"))


@query("""
SELECT doc_id, length(c)::BIGINT AS n, sha256(c) AS digest FROM (
  SELECT doc_id, CASE WHEN length(text) > 1024 THEN text[1:409] || E'\\n…\\n' || substr(text, (length(text) - 409) // 2 + 1, 409) || E'\\n…\\n' || right(text, 204) ELSE text END AS c FROM documents)""")
def compact_text(t: Tables):
    out = t.documents.select("doc_id", T.compact(F.col("text"), 256).alias("c"))
    return out.select("doc_id", F.length("c").cast("bigint").alias("n"), F.sha2("c", 256).alias("digest"))


@query(r"""
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('token=' || doc_id || ' Authorization: Bearer aB' || doc_id || '.x ' || text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
  '(?i)\bbearer\s+[a-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), '(?i)\b(password|api[_-]?key|key|token|secret|authorization|cookie|csrf)(\s*[:=]\s*)([^\s,;&#]+)', '\1\2[REDACTED]', 'g'), '[ \t\n\r]+', ' ', 'g')), 1, 1000) AS message FROM documents""")
def redact_message(t: Tables):
    message = F.concat(F.lit("token="), F.col("doc_id").cast("string"), F.lit(" Authorization: Bearer aB"), F.col("doc_id").cast("string"), F.lit(".x "), "text")
    return t.documents.select("doc_id", T.redact(message).alias("message"))


@query(r"""
SELECT page_id, length(x)::BIGINT AS n, sha256(x) AS digest FROM (SELECT page_id, trim(regexp_replace(
  replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM pages)""")
def html_strip(t: Tables):
    out = t.pages.select("page_id", T.html_strip(F.col("html")).alias("x"))
    return out.select("page_id", F.length("x").cast("bigint").alias("n"), F.sha2("x", 256).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all('a ```python ' || lang || ' ``` b ```' || source || '```', '(?is)```(?:python)?\s*(.*?)```', 1), lambda x: trim(x)), '|') AS code FROM documents""")
def code_blocks(t: Tables):
    made = F.concat(F.lit("a ```python "), "lang", F.lit(" ``` b ```"), "source", F.lit("```"))
    return t.documents.select("doc_id", F.array_join(T.code_blocks(made), "|").alias("code"))


@query("SELECT p_partkey, repeat('`', greatest(3, p_size % 6 + 1)::INT) AS fence FROM part")
def code_fences(t: Tables):
    code = F.concat(F.lit("x "), F.repeat(F.lit("`"), F.col("p_size") % 6), F.lit(" y"))
    return t.part.select("p_partkey", T.fence(code).alias("fence"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def stable_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("digest"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(a, '\[(\d{1,4})\]', 1), lambda x: x::INT)), lambda x: x BETWEEN 1 AND 5)), ',') AS valid,
  array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(a, '\[(\d{1,4})\]', 1), lambda x: x::INT)), lambda x: NOT x BETWEEN 1 AND 5)), ',') AS invalid,
  sha256(regexp_replace(a, '\[(\d{1,4})\]', '〔\1〕', 'g')) AS escaped,
  sha256(trim(regexp_replace(list_reduce(list_prepend(a, list_filter(list_distinct(regexp_extract_all(a, '\[(\d{1,4})\]', 1)), lambda x: NOT x::INT BETWEEN 1 AND 5)), lambda y, x: replace(y, '[' || x || ']', '')), '[ \t]+\n', E'\n', 'g'), E' \t\n\x0B\f\r')) AS cleaned
FROM (SELECT conv_id, turn, '[' || turn || '][2] see [' || conv_id || '] [12345] ' || text AS a FROM conversations)""")
def citations(t: Tables):
    answer = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("][2] see ["), F.col("conv_id").cast("string"), F.lit("] [12345] "), "text")
    valid, invalid = T.cited(F.col("a"), F.lit(5))
    rows = t.conversations.select("conv_id", "turn", answer.alias("a"))
    return rows.select("conv_id", "turn", F.array_join(valid, ",").alias("valid"), F.array_join(invalid, ",").alias("invalid"), F.sha2(T.escape_citations(F.col("a")), 256).alias("escaped"), F.sha2(T.without_invalid(F.col("a"), F.lit(5)), 256).alias("cleaned"))


@query(rf"""
WITH q AS (SELECT doc_id, regexp_replace(text, {_STRIP}) AS text, list_filter(string_split(lower(substr(text, length(text) // 2, 30)), ' '), lambda x: length(x) > 1) AS terms FROM documents),
c AS (SELECT doc_id, text, coalesce(list_min(list_filter(list_transform(terms, lambda x: instr(lower(text), x)), lambda p: p > 0)), 1) - 1 AS centre FROM q)
SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE (CASE WHEN greatest(0, centre - 53) > 0 THEN '…' ELSE '' END) || trim(substr(text, greatest(0, centre - 53) + 1, 160)) ||
  (CASE WHEN greatest(0, centre - 53) + 160 < length(text) THEN '…' ELSE '' END) END AS snippet FROM c""")
def snippets(t: Tables):
    middle = F.col("text").substr(F.floor(F.length("text") / 2).cast("int"), F.lit(30))
    return t.documents.select("doc_id", T.snippet(F.col("text"), F.split(F.lower(middle), " "), 160).alias("snippet"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '(?i)(the|des|und|que)', '<mark>\1</mark>', 'g')) AS marked FROM documents")
def highlight(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.regexp_replace("text", "(?i)(the|des|und|que)", "<mark>$1</mark>"), 256).alias("marked"))


@query("SELECT event_id, round(CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE 1 / (1 + exp(-greatest(-700.0, least(700.0, v)))) END, 6) AS score FROM (SELECT event_id, (value - 50) / 20 AS v FROM events)")
def score_normalize(t: Tables):
    return t.events.select("event_id", F.round(T.sigmoid_score((F.col("value") - 50) / 20), 6).alias("score"))


@query("""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, sha256(name) AS chunk_key
FROM (SELECT doc_id, name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM (SELECT doc_id, doc_id || ':1:0:' || sha256(text) AS name FROM documents))""")
def chunk_keys(t: Tables):
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("1"), F.lit("0"), F.sha2("text", 256))
    return t.documents.select("doc_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", name).alias("point_id"), F.sha2(name, 256).alias("chunk_key"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || json_extract_string(props, '$.k') ELSE '' END AS kept FROM events""")
def scrub_props(t: Tables):
    """Keys that name a credential are dropped from a flat JSON object."""
    props = F.from_json("props", "map<string,string>")
    named = F.transform_keys(props, lambda k, v: F.when(F.col("event_id") % 2 == 0, k).otherwise(F.concat(F.lit("api_token_"), k)))
    kept = F.map_filter(named, lambda k, v: ~k.rlike("(?i)password|secret|token|cookie|authorization"))
    return t.events.select("event_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


@query(
    r"""SELECT event_id, '{"k":' || (props->>'$.k') || ',"list":[' || (event_id % 3) || ',{"note":"Bearer [REDACTED] of ' || user_id || '"},[]],"type":"' || event_type || '"}' AS props FROM events"""
)
def scrub_nested(t: Tables):
    """Credentials go from JSON values at any depth."""
    secret = F.concat(F.lit('{"deep":{"Api_Key":'), F.col("event_id").cast("string"), F.lit('},"note":"Bearer x'), F.col("event_id").cast("string"), F.lit(" of "), F.col("user_id").cast("string"), F.lit('"}'))
    inner = F.concat(F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit(","), F.regexp_replace(secret, '"deep":', '"sessionInfo":'), F.lit(",[]]"))
    props = F.concat(F.lit('{"type":"'), "event_type", F.lit('","list":'), inner, F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit(',"user_token":[1,{"a":2}]}'))
    return V.scrubbed(t.events.select("event_id", props.alias("props")), "props")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_custkey AS c, o_totalprice > 150000 AS dear FROM orders WHERE o_orderstatus <> 'O')
    SELECT o_orderkey, '/title' AS path, '"' || p || '"' AS old, '"Edited: ' || p || '"' AS new FROM o UNION ALL
    SELECT o_orderkey, '/buyer/key', c::VARCHAR, (c + 1)::VARCHAR FROM o UNION ALL
    SELECT o_orderkey, '/tags/1', CASE WHEN dear THEN '"dear"' END, '"edited"' FROM o UNION ALL
    SELECT o_orderkey, '/tags/2', NULL, '"dear"' FROM o WHERE dear"""
)
def edit_audit(t: Tables):
    """Before and after of an edit of nested rows, down to the leaves that changed."""
    first, dear = F.array(F.lit("order")), F.when(F.col("o_totalprice") > 150000, F.array(F.lit("dear"))).otherwise(F.array().cast("array<string>"))
    row = lambda title, buyer, *tags: t.orders.select("o_orderkey", title.alias("title"), F.struct(buyer.alias("key"), F.col("o_orderstatus").alias("status")).alias("buyer"), F.concat(first, *tags).alias("tags"))
    edited = F.col("o_orderstatus") != "O"
    old = row(F.col("o_orderpriority"), F.col("o_custkey"), dear)
    tags = F.when(edited, F.array(F.lit("edited"))).otherwise(F.array().cast("array<string>"))
    new = row(F.when(edited, F.concat(F.lit("Edited: "), "o_orderpriority")).otherwise(F.col("o_orderpriority")), F.col("o_custkey") + edited.cast("int"), tags, dear)
    return V.audit(old, new, "o_orderkey")


@query("""SELECT event_id, sha256('{"a":{"z":"","é":[' || user_id || ',null,{"x":true,"y":"' || event_type || '"}]},"b":' || (props->>'$.k') || '}') AS digest FROM events""")
def stable_hash_nested(t: Tables):
    """The hash of a nested value does not hang on the order or spacing of its keys."""
    value = F.concat(F.lit('{ "b" : '), F.get_json_object("props", "$.k"), F.lit(', "a": {"z":"", "\\u00e9": [ '), F.col("user_id").cast("string"), F.lit(', null, {"y":"'), "event_type", F.lit('","x":true}]}}'))
    return V.canonical_json(t.events.select("event_id", value.alias("props")), "props").select("event_id", F.sha2("props", 256).alias("digest"))
