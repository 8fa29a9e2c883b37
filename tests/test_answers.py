"""Contexts, gates, tags, accounts and filters against plain Python and by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import jobs as J
from siltstone.operators import rag as G
from siltstone.operators import threads as O
from siltstone.operators.filters import SearchFilters


def block(number, title, text):
    return f'<source id="{number}">\nTitle: {title}\n\n{text}\n</source>'


#: Passages (title, id, text), budget, sources, least; the context, its tokens and its sources, written out.
CONTEXTS = {
    "two fit, citations of their own are taken out": ([("one", 7, "cites [1] here"), ("two", 8, "b")], 1000, 6, 40, block(1, "one", "cites 〔1〕 here") + "\n\n" + block(2, "two", "b"), 23, [(1, 7, False), (2, 8, False)]),
    "no more sources than asked for": ([("one", 7, "cites [1] here"), ("two", 8, "b")], 1000, 1, 40, block(1, "one", "cites 〔1〕 here"), 13, [(1, 7, False)]),
    "cut at a line end past the half": ([("one", 7, "a" * 25 + "\n" + "b" * 30)], 10, 6, 5, block(1, "one", "a" * 25), 16, [(1, 7, True)]),
    "cut within the line if its start lies before the half": ([("one", 7, "a" * 10 + "\n" + "b" * 50)], 10, 6, 5, block(1, "one", "a" * 10 + "\n" + "b" * 29), 20, [(1, 7, True)]),
    "cut without any line end": ([("one", 7, "x" * 300)], 10, 6, 5, block(1, "one", "x" * 40), 20, [(1, 7, True)]),
    "too little is left": ([("one", 7, "x" * 300)], 10, 6, 40, "", 0, []),
    "a long one is passed over, a short one behind it fits": ([("one", 7, "x" * 300), ("two", 8, "b")], 11, 6, 40, block(1, "two", "b"), 10, [(1, 8, False)]),
}


@pytest.mark.parametrize("name", CONTEXTS)
def test_contexts_written_out(spark, name):
    passages, budget, sources, least, text, tokens, taken = CONTEXTS[name]
    df = spark.createDataFrame([(passages,)], "ps array<struct<title:string,id:bigint,text:string>>")
    got = df.select(G.context_text(F.col("ps"), budget, sources, least).alias("c")).first()["c"]
    assert (got["text"], got["tokens"], [tuple(s) for s in got["sources"]]) == (text, tokens, taken)


def test_gate_defaults(spark):
    rows = spark.createDataFrame([(0, 100, 1.0), (1, 39, 1.0), (1, 40, 0.24), (1, 40, 0.25), (2, 50, None)], "n int, tokens int, top double")
    assert [r["g"] for r in rows.select(G.context_gate(F.col("n"), F.col("tokens"), F.col("top")).alias("g")).collect()] == ["NO_SOURCES", "FEW_TOKENS", "WEAK", "OK", "WEAK"]


def test_accepted_answer_rules(spark):
    rows = [
        (1, 10, 12, False, "a", 5), (1, 11, 12, True, "b", 9), (1, 12, 12, False, "c", 1),  # the declared one, not the flagged one
        (2, 20, 29, True, "a", 5), (2, 21, 29, False, "b", 7),  # the declared one is missing: nothing is accepted
        (3, 30, 30, False, " ", 5), (3, 31, 30, False, "b", 1),  # the declared one is blank
        (4, 41, None, True, "a", 1), (4, 40, None, True, "b", 1), (4, 42, None, False, "c", 9), (4, 43, None, False, "d", 8),  # the flagged one with the smallest id
    ]
    df = spark.createDataFrame(rows, "q int, id int, declared int, flag boolean, text string, score int")
    got = O.select_corpus_answers(df, "q", "id", "declared", "flag", F.trim("text") != "", [F.desc("score"), F.col("id")], 2).orderBy("q", "rank").collect()
    assert [(r["q"], r["rank"], r["id"], r["accepted"], r["missing_accepted"]) for r in got] == [
        (1, 1, 12, True, False), (1, 2, 11, False, False), (1, 3, 10, False, False), (2, 1, 21, False, True), (2, 2, 20, False, True),
        (3, 1, 31, False, True), (4, 1, 40, True, False), (4, 2, 42, False, False), (4, 3, 43, False, False),
    ]


def test_last_administrator_stays(spark):
    users = spark.createDataFrame([(1, "ADMIN", "ACTIVE", 1), (2, "USER", "ACTIVE", 1), (3, "ADMIN", "BLOCKED", 4)], "id int, role string, status string, version int")
    asked = spark.createDataFrame([(1, 2, "USER", False), (2, 2, "ADMIN", False), (3, 1, None, True)], "id int, actor int, new_role string, block boolean")
    got = {r["id"]: (r["role"], r["status"], r["version"], r["outcome"], r["sessions_revoked"]) for r in J.account_changes(users, asked, "id", "ADMIN").collect()}
    assert got == {1: ("ADMIN", "ACTIVE", 1, "LAST_ADMIN", False), 2: ("USER", "ACTIVE", 1, "SELF", False), 3: ("ADMIN", "BLOCKED", 4, "UNCHANGED", False)}
    other = spark.createDataFrame([(2, 1, "EDITOR", True)], "id int, actor int, new_role string, block boolean")
    assert {r["id"]: (r["role"], r["status"], r["version"], r["outcome"]) for r in J.account_changes(users, other, "id", "ADMIN").collect()}[2] == ("EDITOR", "BLOCKED", 2, "CHANGED")


def test_filters_ask_only_what_is_set(spark):
    rows = spark.createDataFrame([(1, "en", ["a", "b"], "s", 5, True), (2, None, None, None, None, None), (3, "fr", ["a"], "hidden", 50, False)], "id int, lang string, tags array<string>, source string, n int, code boolean")
    names = {"language": "lang", "tags": "tags", "source": "source", "created": "id", "chars": "n", "code": "code"}
    found = lambda **kw: [r["id"] for r in rows.where(SearchFilters(**kw).column(names)).orderBy("id").collect()]
    assert found() == [1, 2, 3] and found(languages=("en",)) == [1] and found(tags=("b", "z")) == [1] and found(tags=("a", "b"), all_tags=True) == [1]
    assert found(hidden_sources=("hidden",)) == [1, 2] and found(created=(2, None)) == [2, 3] and found(least_chars=6) == [3] and found(has_code=False) == [3]
