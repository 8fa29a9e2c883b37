"""Conversation repair against a plain search for the cheapest edits, whole and in segments."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import conversations

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def repaired_by_search(rows):
    """(cost, audit, text) of rows (role, text, fault): every edit is tried at every place."""

    @lru_cache(None)
    def least(i, said, inserts):
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            options.append((0, "", ()))
        expects = lambda r: re.fullmatch("s?(ua)*u?", said + r)
        if inserts < 4:
            for r in "ua":
                if expects(r):
                    c, a, t = least(i, said + r, inserts + 1)
                    options.append((c + 2, "I" + a, (f"{ROLES[r]}:", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = least(i + 1, said, 0)
            options.append((c + 3, "D" + a, t))
            if fault in (None, "truncated"):
                more = 1 if fault else 0
                if role[:1] and role[0] in "sua" and expects(role[0]):
                    c, a, t = least(i + 1, said + role[0], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                for r in "ua":
                    if expects(r):
                        c, a, t = least(i + 1, said + r, 0)
                        options.append((c + 2 + more, "R" + a, (f"{ROLES[r]}:{text}", *t)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return least(0, "", 0)


def by_hand(table):
    """The digest of every conversation, in plain Python."""
    one_space = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{one_space(conv)}:{one_space(turn)}".encode()) % 20
        role, text = one_space(role), one_space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, initials = set(), [], [r[1][:1] for r in rows]
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = repaired_by_search(tuple((r[1], r[2], f) for r, f in zip(rows, faults, strict=True)))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digest(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, repeated and tied rows, odd roles, negative turns, only dropped rows."""
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "a", "ub"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "one. two", "Is it?\n", "x" * 50_000 + ".", "ß. ", "tail "]
    rows = [(c, rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(0, 9))]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + rows[:20] + [(dropped, 0, "user", "Gone.")]


def test_every_conversation_against_a_search(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = digest(conversations.repair(spark, df))
    assert got == want and len({v[6] for v in got.values()}) > 5


def test_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).withColumns({"n": F.lit(1), "symbol": F.lit("s"), "seg": F.lit(0), "rows": F.lit(2)})
    assert digest(conversations.repair(spark, df)) == by_hand(odd_rows)
    assert conversations.repair(spark, df.limit(0)).count() == 0


def test_sql_on_odd_rows(spark, odd_rows):
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(odd_rows, SCHEMA).toArrow())
    answer = con.execute(conversations.REPAIR_SQL)
    names = [c[0] for c in answer.description]
    want = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in want) for r in (dict(zip(names, row, strict=True)) for row in answer.fetchall())}
    assert got == by_hand(odd_rows)


def test_segments_give_the_same(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 1)
    df = spark.createDataFrame(odd_rows, SCHEMA)
    assert digest(conversations.repair(spark, df, long_rows=2)) == by_hand(odd_rows)


def test_a_conversation_of_a_third_of_all_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 8)
    rng = random.Random(3)
    rows = [(None, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut"]) + (str(t) + "." if rng.random() < 0.9 else "")) for t in range(5_000)]
    rows += [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = conversations.repair(spark, df, long_rows=1_000)
    assert digest(cut) == digest(conversations.repair(spark, df))


def test_the_walk_is_the_least_of_the_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7))]
        names = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
        rows = tuple((names.get(s.lower(), "user"), "t", "blank" if s == "x" else "truncated" if s.isupper() else None) for s in symbols)
        cost, audit, _ = repaired_by_search(rows)
        assert conversations.edits_of(symbols)[:2] == (cost, audit)
