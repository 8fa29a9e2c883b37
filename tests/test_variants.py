"""JSON values of any depth scrubbed in the engine, against a walk in plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from siltstone.functions import variants


def by_hand(text):
    def message(s):
        s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", s).strip()
        s = re.sub(r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]", s)
        s = re.sub(r"(?i)\b(password|api[_-]?key|key|token|secret|authorization|cookie|csrf)(\s*[:=]\s*)([^\s,;&#]+)", r"\1\2[REDACTED]", s)
        return " ".join(s.split())[:2000]

    def hidden(k):
        return re.sub("[^a-z0-9]", "", k.lower()) == "key" or any(p in k.lower() for p in variants.SENSITIVE)

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items() if not hidden(k)}
        return [walk(v) for v in x] if isinstance(x, list) else message(x) if isinstance(x, str) else x

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        return None if text is None else json.dumps(walk(json.loads(text, object_pairs_hook=once)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except ValueError:
        return None


def value(rng, depth):
    kinds = ["text", "number", "none", "bool"] + ["object", "list"] * (3 if depth else 0)
    match rng.choice(kinds):
        case "object":
            keys = ["a", "ß", "key", "K-e-y", "user_token", "monkey", 'q"uote', "Session", "zeta", "", "Ünder", "salted", "n\n"]
            return {k: value(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 6))}
        case "list":
            return [value(rng, depth - 1) for _ in range(rng.randint(0, 12))]
        case "text":
            return rng.choice(["", "plain", "Bearer abc.d", "password = x; y", 'a "b" \\ c', "é☃🙂", "  two   words\t", "x" * 3_000, "key:1,token=2"])
        case "number":
            return rng.choice([0, 1, -7, 2**40, 0.5, -2.25, 123456.75])
        case kind:
            return {"none": None, "bool": rng.random() < 0.5}[kind]


def test_any_depth(spark):
    rng = random.Random(29)
    texts = [json.dumps(value(rng, rng.randint(0, 6)), ensure_ascii=rng.random() < 0.5) for _ in range(150)]
    deep = "[" * 30 + '{"a":{"secret":1,"b":[]}}' + "]" * 30
    texts += [None, "", "no json", "{", '{"a":1,"a":2}', "{}", "[]", '"alone"', "3", "null", '{"key":1}', deep, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").withColumns({"value": F.lit(1), "path": F.lit("p"), "a.b": F.lit(2), "key": F.lit("k")})
    got = variants.scrubbed(df, "payload")
    assert sorted(got.columns) == sorted(df.columns)
    rows = got.collect()
    assert {r["id"]: r["payload"] for r in rows} == {i: by_hand(t) for i, t in enumerate(texts)} and len(rows) == len(texts)
    assert all(r["value"] == 1 and r["a.b"] == 2 for r in rows)


def test_other_rules_and_no_rows(spark):
    df = spark.createDataFrame([('{"x":{"drop":1,"y":["a"]}}',)], "j string")
    got = variants.rewrite(df, "j", lambda k: k == "drop", lambda s: F.upper(s), alias="out").first()
    assert (got["j"], got["out"]) == ('{"x":{"drop":1,"y":["a"]}}', '{"x":{"y":["A"]}}')
    assert variants.scrubbed(df.limit(0), "j").count() == 0


def edited(rng, x, depth=0):
    """A value with some leaves, keys and items changed, added or taken away."""
    if isinstance(x, dict) and rng.random() < 0.9:
        out = {k: edited(rng, v, depth + 1) for k, v in x.items() if rng.random() < 0.9}
        return out | ({rng.choice(["new", "a/b", "~t", "0"]): value(rng, 1)} if rng.random() < 0.3 else {})
    if isinstance(x, list) and rng.random() < 0.9:
        return [edited(rng, v, depth + 1) for v in x if rng.random() < 0.9] + ([value(rng, 2)] if rng.random() < 0.3 else [])
    return value(rng, 2) if rng.random() < 0.3 else x


def flat(x, path=""):
    out = {path: "{}" if isinstance(x, dict) else "[]" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)}
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        out |= flat(v, f"{path}/" + str(k).replace("~", "~0").replace("/", "~1"))
    return out


def test_a_difference_can_be_replayed(spark):
    rng = random.Random(37)
    pairs = [(old, edited(rng, old)) for old in (value(rng, rng.randint(0, 5)) for _ in range(120))]
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, json string")
    old = frame([(i, dump(p[0])) for i, p in enumerate(pairs) if i != 5])
    new = frame([(i, dump(p[1])) for i, p in enumerate(pairs) if i != 6])
    changes = variants.difference(old, new).cache()
    want = set()
    for i, (a, b) in enumerate(pairs):
        a, b = ({} if i == 5 else flat(a)), ({} if i == 6 else flat(b))
        want |= {(i, p, a.get(p), b.get(p)) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
    assert {tuple(r) for r in changes.collect()} == want and changes.count() == len(want)
    got = {r["id"]: r["json"] for r in variants.replayed(old, changes).collect()}
    assert got == {i: dump(p[1]) for i, p in enumerate(pairs) if i != 6}
    assert variants.difference(old, old).count() == 0 and variants.difference(old.limit(0), old.limit(0)).count() == 0


def test_audit_of_rows(spark):
    schema = "k int, name string, tags array<string>, place struct<x:int,y:string>"
    old = spark.createDataFrame([(1, "a", ["t", "u"], (1, None)), (2, None, [], (2, "z")), (3, "gone", None, None)], schema)
    new = spark.createDataFrame([(1, "a", ["u"], (1, "n")), (2, None, [], (2, "z"))], schema)
    got = {tuple(r) for r in variants.audit(old, new, "k").where("k < 3").collect()}
    assert got == {(1, "/tags/0", '"t"', '"u"'), (1, "/tags/1", '"u"', None), (1, "/place/y", "null", '"n"')}
    assert {r["path"] for r in variants.audit(old, new, "k").where("k = 3").collect()} == {"", "/name", "/tags", "/place"}
