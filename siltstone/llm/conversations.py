"""Repair of conversations by the cheapest edits that bring their roles back into order.

A conversation is a line of rows; the roles that a model can be trained on are those of a small
automaton: a system turn or none, then user and assistant in turn.  Nodes are (rows read, state),
edits are arcs with costs from 0 to 3, and Dial's bucket queue gives every node its distance to
the end.  The edits are read off by walking arcs that keep to these distances, the least letter
first.  Rows that have to go anyway have one arc each, so the graph leaves them out.

Conversations of a bounded size are gathered by a grouping and solved whole.  Longer ones are sorted
by range into segments: a segment's distances from each state to each state form a small matrix,
matrices are folded along the conversation, and the segments are then walked apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

#: Larger conversations are cut into segments of at most 2 ** SEGMENT_BITS different rows.
SEGMENT_BITS = 16
LONG_ROWS = 1 << 15
LONG_BYTES = 1 << 26
#: So many ids of long conversations at most are sent to every executor.
BROADCAST_IDS = 100_000
#: Symbols of conversations up to this length are solved once a task.
CACHED_LENGTH = 16

WORD = r"[^\x20\x09-\x0D]"
INF = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
#: From the start (0), after a system (1), user (2) and assistant turn (3): the state after a role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = [0, INF, INF, 0]
#: The role that an edit may put in each state.
PUT = "uuau"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1


def _arcs(symbol: str) -> list[list[tuple[str, int, int]]]:
    """(edit, next state, cost) of a row in each state, edits ascending; capitals are rows cut short."""
    more = CUT_SHORT if symbol.isupper() else 0
    out = []
    for state, after in enumerate(NEXT):
        arcs = [("D", state, DELETE)]
        if symbol.lower() in after:
            arcs.append(("K", after[symbol.lower()], KEEP + more))
        out.append([*arcs, ("R", after[PUT[state]], REROLE + more)])
    return out


ARCS = {symbol: _arcs(symbol) for symbol in "suaoSUAO"}
BACK = {symbol: [[(p, cost) for p in range(4) for _, q, cost in arcs[p] if q == state] for state in range(4)] for symbol, arcs in ARCS.items()}
INSERTED = [NEXT[state][PUT[state]] for state in range(4)]


def distances(symbols: str, ends: list[int], last: bool) -> list[int]:
    """Least cost from node 4 * (rows read) + state to the end, where ``ends`` are the costs that follow.

    Dial's algorithm backwards: nodes wait in the bucket of their distance, and as no arc costs more
    than 3, a node only ever opens the next three buckets.  Rows are inserted in front of a row;
    at the end of a segment that is not the last, that is the next one's work.
    """
    n, base = len(symbols), min(ends)
    dist = [INF] * (4 * n + 4)
    buckets = [[] for _ in range(max(e for e in ends if e < INF) - base + 1)]
    for state, e in enumerate(ends):
        if e < INF:
            dist[4 * n + state] = e - base
            buckets[e - base].append(4 * n + state)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:
            if dist[node] != d:
                continue
            row, state = divmod(node, 4)
            arcs = [(4 * row - 4 + p, cost) for p, cost in BACK[symbols[row - 1]][state]] if row else []
            if row < n or last:
                arcs += [(4 * row + p, INSERT) for p in range(4) if INSERTED[p] == state]
            for before, cost in arcs:
                if d + cost < dist[before]:
                    dist[before] = d + cost
                    while len(buckets) <= d + cost:
                        buckets.append([])
                    buckets[d + cost].append(before)
        buckets[d] = ()
        d += 1
    return [x + base if x < INF else INF for x in dist]


def walk(symbols: str, dist: list[int], ends: list[int], last: bool, state: int) -> tuple[list[tuple[str, int, str | None]], int]:
    """(edit, row, new role) along tight arcs, the least edit first, and the state at the end."""
    out, row, n = [], 0, len(symbols)
    while True:
        here = dist[4 * row + state]
        if row == n and (not last or here == ends[state]):
            return out, state
        arcs = [(edit, row + 1, after, cost) for edit, after, cost in ARCS[symbols[row]][state]] if row < n else []
        if row < n or last:
            arcs.insert(1 if arcs else 0, ("I", row, INSERTED[state], INSERT))
        edit, row_after, after, _ = next(a for a in arcs if dist[4 * a[1] + a[2]] + a[3] == here)
        out.append((edit, row, ROLES[PUT[state]] if edit in "IR" else None))
        row, state = row_after, after


def edits_of(symbols: list[str], copies: list[int] | None = None, ends: list[int] = ENDS, last: bool = True, state: int = 0) -> tuple[int, str, list[tuple[int, str | None]]]:
    """Cost, audit and lines (row or -1, new role) of rows, of which those with the symbol x have to go.

    ``copies`` says how often each row stands there; all but the first have to go.
    """
    copies = copies or [1] * len(symbols)
    kept = [i for i, s in enumerate(symbols) if s != "x"]
    doomed, at = [0] * (len(kept) + 1), 0  # rows that have to go before each kept one
    for s, n in zip(symbols, copies, strict=True):
        if s == "x":
            doomed[at] += n
        else:
            at += 1
            doomed[at] += n - 1
    left = "".join(symbols[i] for i in kept)
    dist = distances(left, ends, last)
    path, _ = walk(left, dist, ends, last, state)
    audit, lines, told = ["D" * doomed[0]], [], 0
    for edit, row, role in path:
        while told < row:
            told += 1
            audit.append("D" * doomed[told])
        audit.append(edit)
        if edit != "D":
            lines.append((-1 if edit == "I" else kept[row], role))
    audit.extend("D" * n for n in doomed[told + 1 :])
    return dist[state] + DELETE * sum(doomed), "".join(audit), lines


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row after damage; copies is 0 for a row that is dropped.

    The damage follows from crc32 of `conv_id:turn`; nulls count as one space there, in role and in text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def is_blank() -> Column:
    return ~F.col("text").rlike(WORD)


def cut_short() -> Column:
    return ~F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z")


def symbol(duplicate: Column) -> Column:
    return F.when(is_blank() | duplicate, "x").when(cut_short(), F.upper(initial())).otherwise(initial())


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _solve(symbols: pd.Series) -> pd.DataFrame:
    """Cost, audit and lines of each string of symbols."""
    known, out = {}, []
    for s in symbols:
        found = known.get(s)
        if found is None:
            cost, audit, lines = edits_of(list(s))
            found = (cost, audit, [{"at": at, "role": role} for at, role in lines])
            if len(s) <= CACHED_LENGTH:
                known[s] = found
        out.append(found)
    return pd.DataFrame(out, columns=["cost", "audit", "lines"])


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of a bounded size, each gathered into one array of rows."""
    same = Window.partitionBy("conv_id", "role", "text", F.col("copies") > 0).orderBy("turn")
    each = rows.repartition("conv_id").withColumn("copy", F.explode(F.when(F.col("copies") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    each = each.withColumn("duplicate", F.row_number().over(same) > 1)
    row = F.struct("turn", "role", "text", symbol(F.col("duplicate")).alias("symbol"), initial().alias("initial"), is_blank().alias("blank"), "duplicate")
    got = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, row))).alias("rows"))
    turns = F.array_compact(F.transform("rows", lambda r: r["turn"]))
    count = lambda test: F.size(F.filter("rows", test)).cast("long")
    initials, n = F.transform("rows", lambda r: r["initial"]), F.size("rows")
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(initials, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: _legal(a, b))
    solve = F.pandas_udf(_solve, "struct<cost: bigint, audit: string, lines: array<struct<at: int, role: string>>>")
    got = got.withColumn("plan", solve(F.array_join(F.transform("rows", lambda r: r["symbol"]), "")))
    line = lambda x: F.concat(F.coalesce(x["role"], F.get("rows", x["at"])["role"]), F.lit(":"), F.coalesce(F.get("rows", x["at"])["text"], F.lit("")))
    return got.select(
        "conv_id",
        F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long").alias("gaps"),
        count(lambda r: r["blank"]).alias("blank"),
        count(lambda r: r["duplicate"] & ~r["blank"]).alias("duplicate"),
        count(lambda r: r["symbol"].isin("S", "U", "A", "O")).alias("truncated"),
        F.size(F.filter(pairs, lambda ok: ~ok)).cast("long").alias("illegal"),
        F.col("plan.cost").alias("cost"), F.col("plan.audit").alias("audit"),
        F.sha2(F.array_join(F.transform("plan.lines", line), "\n"), 256).alias("repaired_sha256"),
    )


def _joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join on equal keys, nulls too, that keeps a's."""
    b = b.select(*(F.col(c).alias(f"{c}_b" if c in keys else c) for c in b.columns))
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"{k}_b"])
    return a.join(b, on, how).drop(*(f"{k}_b" for k in keys))


def _segmented(spark: SparkSession, rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Conversations of any size, as segments of rows sorted by range."""
    runs = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    order = ["conv_id", "turn", "role"]
    ordered = runs.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").withColumn("id", F.monotonically_increasing_id())
    ordered = scratch.keep("ordered", ordered.withColumn("seg", F.shiftright("id", SEGMENT_BITS)))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    light = ordered.select("conv_id", "turn", "id", "seg", "n", key.alias("key"), initial().alias("initial"), is_blank().alias("blank"), symbol(F.lit(False)).alias("symbol"))
    first = light.groupBy("conv_id", "key").agg(F.min("id").alias("first"))
    light = _joined(light, first, "conv_id", "key").withColumn("again", F.col("id") > F.col("first"))
    light = scratch.keep("light", light.withColumn("symbol", F.when(F.col("again"), "x").otherwise(F.col("symbol"))).drop("key", "first"))
    counts = light.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("symbol").isin("S", "U", "A", "O").cast("long")).alias("truncated"),
        F.sum(F.when(F.col("symbol") == "x", F.col("n")).otherwise(F.col("n") - 1)).alias("doomed"),
    )
    turns = light.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))

    part = F.sort_array(F.collect_list(F.struct("id", "symbol", "n", "initial")))
    segments = light.groupBy("conv_id", "seg").agg(part.alias("rows"))
    field = lambda name: F.transform("rows", lambda r: r[name])
    marks = field("initial")
    inside = F.zip_with(F.slice(marks, F.lit(1), F.size(marks) - 1), F.slice(marks, F.lit(2), F.size(marks) - 1), lambda a, b: _legal(a, b))
    segments = segments.select(
        "conv_id", "seg", F.array_join(field("symbol"), "").alias("symbols"), field("n").alias("copies"), field("id").alias("ids"), F.element_at(marks, 1).alias("mark0"), F.element_at(marks, -1).alias("mark1"),
        (F.size(F.filter(inside, lambda ok: ~ok)) + F.aggregate(field("n"), F.lit(0).cast("long"), lambda s, n: s + n - 1)).alias("illegal"),
    )
    whole = Window.partitionBy("conv_id")  # one row a segment
    segments = segments.withColumns({"last": F.col("seg") == F.max("seg").over(whole), "mark_before": F.lag("mark1").over(whole.orderBy("seg"))})
    segments = scratch.keep("segments", segments)
    illegal = segments.groupBy("conv_id").agg(F.sum(F.col("illegal") + F.when(F.col("mark_before").isNotNull() & ~_legal(F.col("mark_before"), F.col("mark0")), 1).otherwise(0)).alias("illegal"))

    @F.pandas_udf("array<bigint>")
    def matrix(symbols, last):
        out = []
        for s, is_last in zip(symbols, last, strict=True):
            left, cells = s.replace("x", ""), []
            for end in range(4):
                cells += distances(left, ENDS if is_last else [0 if e == end else INF for e in range(4)], bool(is_last))[:4]
            out.append(cells)  # [4 * end state + state]
        return pd.Series(out)

    @F.pandas_udf("array<struct<seg: bigint, ends: array<bigint>, cost: bigint>>")
    def fold(parts):
        out = []
        for rows in parts:
            ends, found = ENDS, []
            for i, r in enumerate(reversed(rows)):
                m = r["matrix"]
                starts = [int(min(INF, min(int(m[4 * e + q]) + (ends[e] if i else 0) for e in range(4)))) for q in range(4)]
                found.append({"seg": r["seg"], "ends": list(ends), "cost": starts[0]})
                ends = starts
            out.append(found)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def exits(symbols, ends, last):
        out = []
        for s, e, is_last in zip(symbols, ends, last, strict=True):
            left, e = s.replace("x", ""), [int(x) for x in e]
            dist = distances(left, e, bool(is_last))
            out.append([walk(left, dist, e, bool(is_last), q)[1] if dist[q] < INF else -1 for q in range(4)])
        return pd.Series(out)

    @F.pandas_udf("array<struct<seg: bigint, state: int>>")
    def entered(parts):
        out = []
        for rows in parts:
            state, found = 0, []
            for r in rows:
                found.append({"seg": r["seg"], "state": state})
                state = int(r["exits"][state])
            out.append(found)
        return pd.Series(out)

    @F.pandas_udf("struct<audit: string, lines: array<struct<id: bigint, role: string>>>")
    def solve(symbols, copies, ids, ends, last, state):
        out = []
        for s, n, i, e, is_last, q in zip(symbols, copies, ids, ends, last, state, strict=True):
            _, audit, lines = edits_of(list(s), [int(x) for x in n], [int(x) for x in e], bool(is_last), int(q))
            out.append((audit, [{"id": int(i[at]) if at >= 0 else None, "role": role} for at, role in lines]))
        return pd.DataFrame(out, columns=["audit", "lines"])

    in_order = lambda *c: F.sort_array(F.collect_list(F.struct("seg", *c)))
    parts = segments.select("conv_id", "seg", matrix("symbols", "last").alias("matrix")).groupBy("conv_id").agg(in_order("matrix").alias("parts"))
    ends = parts.select("conv_id", F.explode(fold("parts")).alias("p")).select("conv_id", "p.seg", "p.ends", "p.cost")
    segments = scratch.keep("ended", _joined(segments, ends, "conv_id", "seg"))
    found = segments.select("conv_id", "seg", exits("symbols", "ends", "last").alias("exits")).groupBy("conv_id").agg(in_order("exits").alias("parts"))
    entries = found.select("conv_id", F.explode(entered("parts")).alias("p")).select("conv_id", "p.seg", "p.state")
    solved = _joined(segments, entries, "conv_id", "seg").select("conv_id", "seg", "cost", solve("symbols", "copies", "ids", "ends", "last", "state").alias("plan"))
    solved = scratch.keep("solved", solved)
    audits = solved.groupBy("conv_id").agg(F.array_join(F.transform(in_order("plan.audit"), lambda p: p["audit"]), "").alias("audit"), F.min_by("cost", "seg").alias("cost"))
    lines = solved.select("conv_id", "seg", F.posexplode("plan.lines").alias("k", "line")).select("conv_id", "seg", "k", "line.id", F.col("line.role").alias("new_role"))
    lines = lines.join(ordered.select("id", "role", "text"), "id", "left")
    lines = lines.select("conv_id", "seg", "k", F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "k").select("conv_id", "line").mapInArrow(_hash_lines, "conv_id bigint, repaired_sha256 string")
    out = ids.select("conv_id")
    for more in (turns, counts, illegal, audits, hashes):
        out = _joined(out, more, "conv_id", how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id", zero("gaps").alias("gaps"), zero("blank").alias("blank"), zero("duplicate").alias("duplicate"), zero("truncated").alias("truncated"), zero("illegal").alias("illegal"),
        zero(F.col("cost") + DELETE * F.col("doomed")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each conversation's lines, which follow each other; memory holds one batch."""
    now, state = None, None

    def told(conv, digest):
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if state is not None and conv == now:
                state.update(b"\n")
            else:
                if state is not None:
                    yield told(now, state)
                now, state = conv, hashlib.sha256()
            state.update(line.encode())
    if state is not None:
        yield told(now, state)


def repair(spark: SparkSession, conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for every conv_id of conversations (conv_id, turn, role, text), after damaged().

    Rows are taken by turn, nulls first, then by role and text, both by code point.  Null conv_ids are one
    conversation.  Roles count by their first letter, and one that begins otherwise than s, u or a (an
    empty one too) is never kept as it is.  Repeated rows are duplicates of the first; very long texts go
    through whole; other columns are ignored; an empty table gives an empty result.  A conversation of
    more than ``long_rows`` rows or ``long_bytes`` of text is solved in segments, with the same result.
    """
    rows = damaged(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("role"), F.lit(0))
    totals = conversations.select(F.col("conv_id").cast("long"), size.alias("size")).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    scratch = Scratch(spark, "conversations")
    ids = scratch.keep("long", totals.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("conv_id"))
    n_long = ids.count()
    if not n_long:
        return _whole(rows)
    some = F.broadcast(ids) if n_long <= BROADCAST_IDS else ids
    split = lambda how: rows.join(some, rows["conv_id"].eqNullSafe(some["conv_id"]), how)
    return _whole(split("left_anti")).unionByName(_segmented(spark, split("left_semi"), ids, scratch))


def repair_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation; see repair()."""
    return repair(spark, conversations)


def _sql() -> str:
    """DuckDB SQL of repair() over conversations: a row at a time, the least (cost, audit) of each state so far.

    Two cheapest ways into one state never begin one another, so the least audit of each is all that is needed.
    """
    far = 1_000_000_000

    def put(state: str, cost: str, edit: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}}}"

    def inserted(state: str, role: str) -> str:
        return put(state, str(INSERT), "I", f"'{role}:'")

    def kept(state: str, initial_: str) -> str:
        return put(state, f"CASE WHEN own = '{initial_}' AND NOT doomed THEN cut ELSE {far} END", "K", "role || ':' || text")

    def changed(state: str, role: str) -> str:
        return put(state, f"CASE WHEN NOT doomed THEN {REROLE} + cut ELSE {far} END", "R", f"'{role}:' || text")

    def gone(state: str) -> str:
        return f"{{'c': {state}.c + {DELETE}, 'a': {state}.a || 'D', 't': {state}.t}}"

    user = f"list_min([s3, {inserted('s1', 'user')}, {inserted('s2', 'user')}, {inserted('s4', 'user')}])"
    assistant = f"list_min([s4, {inserted('u', 'assistant')}])"
    before = ("s1", "s2", "a")  # states that a user turn may follow
    after_user = ", ".join([gone("u"), *(kept(x, "u") for x in before), *(changed(x, "user") for x in before)])
    after_assistant = ", ".join([gone("a"), kept("u", "a"), changed("u", "assistant")])
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    bits = "flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20"
    space = r"E' \t\n\x0B\f\r'"
    start, unreached = "{'c': 0, 'a': '', 't': ''}", f"{{'c': {far}, 'a': '', 't': ''}}"
    return rf"""
WITH RECURSIVE
kinds AS (SELECT *, {crc} AS kind FROM (SELECT *, {key} AS key FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
seen AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, {space}) AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS own
  FROM damaged d JOIN convs ON convs.conv_id IS NOT DISTINCT FROM d.conv_id),
marked AS (SELECT *, i > min(i) OVER (PARTITION BY c, role, text) AS again FROM seen),
judged AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS repeated, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS short, lag(own) OVER (PARTITION BY c ORDER BY i) AS last FROM marked),
told AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE repeated) AS duplicate,
         count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE last || own NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c),
walk AS (
  SELECT c, 0::BIGINT AS i, {start} AS s1, {unreached} AS s2, {unreached} AS s3, {unreached} AS s4 FROM convs
  UNION ALL
  SELECT c, i, {gone('s1')}, list_min([{gone('s2')}, {kept('s1', 's')}]), list_min([{after_user}]), list_min([{after_assistant}])
  FROM (SELECT *, {assistant} AS a FROM (
    SELECT w.c, j.i, s1, s2, s3, s4, j.role, j.text, j.own, j.blank OR j.repeated AS doomed, j.short::INTEGER AS cut, {user} AS u FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1))),
ends AS (SELECT c, i, list_min([s1, {assistant}]) AS e FROM (SELECT *, {user} AS u FROM walk))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       e.c::BIGINT AS cost, e.a AS audit, sha256(e.t) AS repaired_sha256
FROM convs LEFT JOIN told ON told.c = convs.c JOIN ends ON ends.c = convs.c AND ends.i = coalesce(told.n, 0)
"""


#: DuckDB SQL of repair() over conversations.
REPAIR_SQL = _sql()
