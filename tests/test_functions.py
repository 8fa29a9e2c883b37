import hashlib
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import markup, text as T
from siltstone.operators import chunking, evaluation as E, rag as G, retrieval as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def clean(spark, *sources, **limits):
    rows = spark.createDataFrame(list(enumerate(sources)), "id bigint, html string")
    return [r.asDict(recursive=True) for r in markup.cleaned(rows, "id", "html", **limits).orderBy("id").collect()]


def test_clean_html_blocks(spark):
    page = "<h2>Title</h2><p>Some <code>x = 1</code> and <a href='https://a.b/c'>link</a></p><ul><li>one</li><li> </li><li>two <b>bold</b></li></ul><ol><li>first</li><li>second</li></ol><blockquote><p>said</p>\n<p>so</p></blockquote><pre><code class='language-Python'>print(1)\n</code></pre><script>bad()</script>"
    (got,) = clean(spark, page)
    assert [(b["kind"], b["text"], b["language"]) for b in got["blocks"]] == [
        ("heading", "## Title", None), ("paragraph", "Some `x = 1` and [link](https://a.b/c)", None), ("list", "- one\n- two bold", None), ("list", "1. first\n2. second", None),
        ("quote", "> said\n> so", None), ("code", "```python\nprint(1)\n```", "python"),
    ]
    assert got["has_code"] and "bad" not in got["text"] and "script" not in got["sanitized"]
    assert got["text"] == "\n\n".join(b["text"] for b in got["blocks"])


def test_code_in_a_line_is_no_code_block(spark):
    inline, outside, nested = clean(spark, "<p>Some <code>x</code></p>", "a <b>b</b><br>c", "<ul><li>a<ul><li>b</li></ul></li></ul><p>one<p>two")
    assert not inline["has_code"] and inline["text"] == "Some `x`"
    assert [b["text"] for b in outside["blocks"]] == ["a", "b", "c"]
    assert [b["text"] for b in nested["blocks"]] == ["- ab", "one", "two"]


def test_clean_html_is_safe_and_bounded(spark):
    got, long, none, empty = clean(spark, "<p onclick='x()'>a<a href='javascript:x()'>b</a></p><!-- c --><iframe>d</iframe><table><tr><td>t</td></tr></table>", "x" * 2000, None, "", max_bytes=1000)
    assert got["sanitized"] == "<p>a<a>b</a></p>t" and got["text"] == "ab\n\nt"
    assert long["error"] == "HTML_TOO_LARGE" and long["text"] == "" and long["blocks"] == []
    assert none["text"] == "" and none["error"] is None and empty["blocks"] == [] and empty["error"] is None
    assert clean(spark, "a b c d e f", max_chars=5)[0]["error"] == "CLEANED_CONTENT_TOO_LARGE"


def test_fences_outgrow_back_ticks(spark):
    assert clean(spark, "<pre>a ```` b</pre>")[0]["text"].startswith("`````\n")
    assert one(spark, T.fence(F.lit("a ```` b"))) == "`````"


def test_clean_title():
    assert markup.clean_title("  How &lt;b&gt;to&lt;/b&gt;\r\n sort? ") == "How to sort?"


def test_uuid5_equals_the_standard(spark):
    ns = uuid.NAMESPACE_URL
    assert one(spark, T.uuid5(ns.hex, F.lit("doc:1:é"))) == str(uuid.uuid5(ns, "doc:1:é"))


def test_urls(spark):
    rows = {
        "HTTP://Example.COM:80/a/b/?b=2&utm_source=x&a=1#frag": "http://example.com:80/a/b?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com/?ref=1": "https://example.com/",
        "ftp://example.com/x": None,
        "no address": None,
    }
    for raw, want in rows.items():
        assert one(spark, T.normalize_url(F.lit(raw))) == want


def test_redaction(spark):
    got = one(spark, T.redact(F.lit("a\x01  Bearer abc.def\npassword = hunter2; ok")))
    assert got == "a Bearer [REDACTED] password = [REDACTED]; ok"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b!", "ü", "x_1", "-", "  ", "\n"]), max_size=20))
def test_token_count_equals_python(spark, parts):
    text = " ".join(parts)
    assert one(spark, T.token_count(F.lit(text))) == len(re.findall(r"\w+|[^\w\s]", text))


def test_pack_keeps_every_block_once(spark):
    lines = [("w " * n).strip() for n in (50, 80, 10, 5, 130, 3, 119, 2)]
    text = "\n".join(lines)
    chunks = one(spark, chunking.pack(chunking.blocks(F.lit(text)), 120, 180, 20))
    assert [i for c in chunks for i in range(c["a"], c["b"] + 1)] == list(range(len(lines)))
    assert sum(c["n"] for c in chunks) == sum(len(x.split()) for x in lines)
    assert one(spark, chunking.pack(chunking.blocks(F.lit("")), 120, 180, 20)) == []


def test_fusion_keeps_missing_parts_null(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "q int, d int, score double, rank bigint")
    b = spark.createDataFrame([(1, 11, 0.7, 1), (1, 12, 0.6, 2)], "q int, d int, score double, rank bigint")
    rows = R.fuse(a, b, "q", "d", 10).orderBy("rank").collect()
    assert [r["d"] for r in rows] == [11, 10, 12]
    assert rows[1]["rank_b"] is None and rows[2]["rank_a"] is None


def test_context_skips_without_stopping(spark):
    ps = spark.createDataFrame([(1, [(1, 900), (2, 100), (3, 90), (4, 5)])], "q int, ps array<struct<id:bigint,n:bigint>>")
    got = ps.select(G.pack_context(F.col("ps"), 930, 40, 6).alias("x")).first()["x"]
    assert [(p["id"], p["n"], p["cut"]) for p in got] == [(1, 900, False), (4, 5, False)]


def test_measures_of_unmatched_query_are_zero(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q int, d int, rank bigint")
    relevant = spark.createDataFrame([(1, 6), (2, None)], "q int, d int")
    rows = {r["q"]: r for r in E.ranking_measures(ranked, relevant, "q", "d", 10).collect()}
    assert rows[1]["recall"] == 1.0 and rows[1]["mrr"] == 0.5 and rows[1]["ndcg"] == round(1 / 1.5849625007211562, 6)
    assert (rows[2]["recall"], rows[2]["hit"], rows[2]["mrr"], rows[2]["ndcg"]) == (0.0, 0, 0.0, 0.0)


def test_page_beyond_the_window_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        R.page(spark.range(1), "id", [F.col("id")], 6, 100)


def test_hash_is_sha256(spark):
    assert one(spark, F.sha2(F.lit("a"), 256)) == hashlib.sha256(b"a").hexdigest()
