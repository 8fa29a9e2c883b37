"""Marks of many queries' terms in many texts, by one automaton for all terms.

The terms of a block of queries make an Aho-Corasick automaton in each task; a text that several
queries found is read once, and each query takes its own occurrences from what the automaton tells:
the leftmost, of those the longest, without overlaps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many queries share an automaton, and so many queries at most read one text together.
QUERY_BLOCK, TOGETHER = 5_000, 64


def folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay where they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def longest_first(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The leftmost of the spans, of those the longest, and so on behind it."""
    out, at = [], 0
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append((start, end))
            at = end
    return out


def highlighted(pairs: DataFrame, queries: DataFrame, texts: DataFrame, query: str, key: str, terms: Column, text: str) -> DataFrame:
    """query, key and spans (start and end by characters, from 0) of each pair (query, key).

    ``terms`` makes an array of a query's terms from a row of queries; empty ones mark nothing.  Case
    doesn't count.  Pairs of unknown queries or texts are left out, null texts have no spans, repeated pairs come once.
    Queries go out in blocks of QUERY_BLOCK, and hot texts are read by groups of at most about TOGETHER queries.
    """
    spark = pairs.sparkSession
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for i in range(blocks):
        mine = F.pmod(F.xxhash64(query), F.lit(blocks)) == i
        rows = queries.where(mine).select(query, F.array_distinct(F.filter(terms, lambda t: F.length(t) > 0)).alias("terms")).collect()
        shared = spark.sparkContext.broadcast({r[query]: [folded(t) for t in r["terms"] or ()] for r in rows})
        groups = max(1, -(-len(rows) // TOGETHER))
        asked = pairs.where(mine).select(query, key).distinct().groupBy(key, F.pmod(F.xxhash64(query, F.lit(1)), F.lit(groups)).alias("part")).agg(F.collect_list(query).alias("asked"))
        found = asked.join(texts.select(key, F.col(text).alias("text")), key).select(key, "asked", "text")
        part = found.mapInPandas(_marker(shared, query, key), f"{query} bigint, {key} bigint, spans array<struct<start:int,end:int>>")
        out = part if out is None else out.unionByName(part)
    return out


def _marker(shared, query: str, key: str):
    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        automaton, owners = ahocorasick.Automaton(), defaultdict(set)
        for q, own in terms.items():
            for t in own:
                owners[t].add(q)
        for t in owners:
            automaton.add_word(t, t)
        if owners:
            automaton.make_automaton()
        for frame in frames:
            told = []
            for own, asked, text in zip(frame[key], frame["asked"], frame["text"], strict=True):
                here, spans = {q for q in asked if q in terms}, defaultdict(list)
                if owners and text:
                    for last, term in automaton.iter(folded(text)):
                        for q in owners[term] & here if len(owners[term]) > len(here) else (q for q in owners[term] if q in here):
                            spans[q].append((last + 1 - len(term), last + 1))
                told += [(q, own, [{"start": a, "end": b} for a, b in longest_first(spans[q])]) for q in sorted(here)]
            yield pd.DataFrame(told, columns=[query, key, "spans"])

    return mark


def marked(text: Column, spans: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with its spans between two marks."""
    piece = lambda start, end: F.substr(text, start + 1, end - start)
    state = F.struct(F.lit("").alias("said"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["said"], piece(s["at"], x["start"]), F.lit(before), piece(x["start"], x["end"]), F.lit(after)).alias("said"), x["end"].alias("at"))
    return F.aggregate(spans, state, step, lambda s: F.concat(s["said"], F.substr(text, s["at"] + 1)))
