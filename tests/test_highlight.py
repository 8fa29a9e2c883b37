"""Marks by the automaton against a regular expression for each query."""

import random
import re

from pyspark.sql import functions as F

from siltstone.operators import highlight


def test_marks_equal_a_pattern_for_each_query(spark, monkeypatch):
    monkeypatch.setattr(highlight, "QUERY_BLOCK", 7)
    monkeypatch.setattr(highlight, "TOGETHER", 2)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abÄß") for _ in range(rng.randint(1, 4)))
    queries = [(i, [word() for _ in range(rng.randint(0, 6))] + rng.choice([[], [""], ["a.b", "("]])) for i in range(20)]
    texts = [(i, rng.choice([None, ""]) if i < 2 else "".join(rng.choice("abAÄäßB.( İ") for _ in range(rng.randint(0, 300)))) for i in range(30)]
    pairs = [(q, d) for q in range(22) for d in range(0, 33, 1 + q % 4)] + [(0, 3), (0, 3)]
    got = highlight.highlighted(
        spark.createDataFrame(pairs, "q bigint, d bigint"), spark.createDataFrame(queries, "q bigint, terms array<string>"), spark.createDataFrame(texts, "d bigint, body string"), "q", "d", F.col("terms"), "body"
    )
    rows = got.join(spark.createDataFrame(texts, "d bigint, body string"), "d").select("q", "d", highlight.marked(F.col("body"), F.col("spans")).alias("m")).collect()
    assert {(r["q"], r["d"]) for r in rows} == {(q, d) for q, d in pairs if q < 20 and d < 30} and len(rows) == len({(r["q"], r["d"]) for r in rows})
    asked, said = dict(queries), dict(texts)
    for r in rows:
        terms = sorted({t for t in asked[r["q"]] if t}, key=len, reverse=True)
        text = said[r["d"]]
        want = text if text is None or not terms else re.sub("(?i)" + "|".join(map(re.escape, terms)), lambda m: f"<mark>{m[0]}</mark>", text)
        assert r["m"] == want


def test_no_queries_and_no_pairs(spark):
    pairs, texts = spark.createDataFrame([(1, 1)], "q bigint, d bigint"), spark.createDataFrame([(1, "x")], "d bigint, body string")
    none = spark.createDataFrame([], "q bigint, terms array<string>")
    assert highlight.highlighted(pairs, none, texts, "q", "d", F.col("terms"), "body").count() == 0
    some = spark.createDataFrame([(1, ["x"])], "q bigint, terms array<string>")
    assert highlight.highlighted(pairs.limit(0), some, texts, "q", "d", F.col("terms"), "body").count() == 0
