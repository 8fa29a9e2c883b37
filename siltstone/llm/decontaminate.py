"""Documents that contain benchmark passages, by greedy string tiling.

Words are runs of letters and digits, lower-cased.  Seeds are runs of ``MIN_MATCH`` words that a
document and a benchmark item share.  Where they could cover enough of the item, tiling finds the
longest match whose words are still free on both sides by running Karp-Rabin hashes and marks it,
again and again, so that reordered passages count in full and no word counts twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.near_dedup import without
from siltstone.llm.scratch import Scratch
from siltstone.llm.textkit import LOWER, NOT_ALNUM, Words, mix, slices

MIN_MATCH = 4
#: Share of an item's words under tiles from which the document counts as contaminated.
COVERAGE = 0.5
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

PAIRS = "doc_id bigint, item_id bigint, item_words bigint, covered_words bigint, n_tiles bigint, longest_tile bigint, coverage double"


def _words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    lowered = pc.utf8_lower(column)
    for first, end, raw, offsets in slices(lowered):
        yield first, end, Words(raw, offsets, NOT_ALNUM, LOWER)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n + 1, _BASE, np.uint64))


class Runs:
    """Hashes of the runs of any length over a sequence of word hashes (Karp-Rabin), and which words are still free.

    ``at`` are the words' places; a run may not step over a gap in them.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words, self.at, self.free = words, at, np.ones(len(words), bool)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words, 5) * _powers(len(words))[:-1], dtype=np.uint64)])

    def of(self, n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the free runs of n words; ``longest`` is at least every sequence's length."""
        if len(self.words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        i = np.flatnonzero((taken[n:] == taken[:-n]) & (self.at[n - 1 :] - self.at[: len(self.at) - n + 1] == n - 1))
        # shifted to one power, so that equal runs have equal hashes wherever they stand
        return i, (self.sums[i + n] - self.sums[i]) * _powers(longest)[longest - i]


def tile(doc: np.ndarray, item: np.ndarray, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, length) of two sequences of word hashes.

    The longest run that is free on both sides is found by bisection over run hashes; all runs of
    that length are marked in order of document place, then item place, and so on with what is
    still free.  Memory follows the two lengths, however often either repeats itself.
    """
    d, t = Runs(doc, np.arange(len(doc)) if at is None else at), Runs(item, np.arange(len(item)))
    longest, most, tiles = max(len(doc), len(item)), min(len(doc), len(item)), []

    def common(n: int) -> bool:
        own, other = d.of(n, longest)[1], np.sort(t.of(n, longest)[1])
        return len(other) > 0 and bool((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).any())

    while most >= MIN_MATCH and common(MIN_MATCH):
        low = MIN_MATCH
        while low < most:  # low is common
            middle = (low + most + 1) // 2
            if common(middle):
                low = middle
            else:
                most = middle - 1
        (i, own), (j, other) = d.of(low, longest), t.of(low, longest)
        places: dict[int, deque[int]] = {}
        for k, h in zip(j.tolist(), other.tolist(), strict=True):
            places.setdefault(h, deque()).append(k)
        met, before = np.isin(own, other), len(tiles)
        for k, h in zip(i[met].tolist(), own[met].tolist(), strict=True):
            if not d.free[k] or not d.free[k + low - 1]:
                continue
            # a run that was free and is as long as any tile is touched at one of its ends
            while (rest := places[h]) and not (t.free[rest[0]] and t.free[rest[0] + low - 1]):
                rest.popleft()
            if rest and np.array_equal(doc[k : k + low], item[rest[0] : rest[0] + low]):
                m = rest.popleft()
                d.free[k : k + low] = t.free[m : m + low] = False
                tiles.append((int(d.at[k]), m, low))
        if len(tiles) == before:  # equal hashes of unequal runs
            most = low - 1
    return tiles


class _Items:
    """Distinct seeds of benchmark items, sorted, with the places that have them."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words, seeds, owners, places = ids, [], [], [], []
        for first, end, words in _words(pa.array(texts, pa.string())):
            hashes, bounds = words.shingles(MIN_MATCH, short=False)
            counts = np.diff(bounds)
            seeds.append(hashes)
            owners.append(np.repeat(np.arange(first, end), counts))
            places.append(np.arange(len(hashes)) - np.repeat(bounds[:-1], counts))
            self.words += np.split(words.hash, words.bounds[1:-1])
        empty = np.zeros(0, np.int64)
        every = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.owners, self.places = np.concatenate([*owners, empty])[order].astype(np.int64), np.concatenate([*places, empty])[order].astype(np.int64)
        self.seeds, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.sizes = np.array([len(w) for w in self.words], np.int64)

    def known(self, seeds: np.ndarray) -> np.ndarray:
        """The number of each seed, or -1."""
        if not len(self.seeds):
            return np.full(len(seeds), -1)
        at = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        return np.where(self.seeds[at] == seeds, at, -1)

    def matches(self, words: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
        """A row for each item whose tiles over a document cover enough of it; known: the document's seeds, numbered."""
        met = np.unique(known[known >= 0])
        if not len(met):
            return
        counts = self.last[met] - self.first[met]
        entry = np.repeat(self.first[met] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        seed, owner, place = np.repeat(met, counts), self.owners[entry], self.places[entry]
        order = np.lexsort((place, owner))
        seed, owner, place = seed[order], owner[order], place[order]
        # words under seeds: tiles can't cover more
        under = np.full(len(owner), MIN_MATCH)
        under[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(place), MIN_MATCH), MIN_MATCH)
        enough = np.flatnonzero(np.bincount(owner, under, len(self.sizes)) >= np.maximum(COVERAGE * self.sizes, 1))
        for own in enough.tolist():
            lo, hi = np.searchsorted(owner, [own, own + 1])
            inside = np.zeros(len(words), bool)
            starts = np.flatnonzero(np.isin(known, seed[lo:hi]))
            for j in range(MIN_MATCH):
                inside[starts + j] = True
            at, size = np.flatnonzero(inside), int(self.sizes[own])
            tiles = tile(words[at], self.words[own], at)
            covered = sum(n for _, _, n in tiles)
            if covered >= COVERAGE * size:
                yield self.ids[own], size, covered, len(tiles), max(n for _, _, n in tiles), covered / size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PAIRS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items = _Items(*shared.value)
    for batch in batches:
        rows, ids = [], batch.column("doc_id")
        for first, end, words in _words(batch.column("text")):
            seeds, bounds = words.shingles(MIN_MATCH, short=False)
            known = items.known(seeds)
            hits = np.concatenate([[0], np.cumsum(known >= 0)])
            for d in np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]]):
                own = words.hash[words.bounds[d] : words.bounds[d + 1]]
                rows += [(ids[first + int(d)].as_py(), *m) for m in items.matches(own, known[bounds[d] : bounds[d + 1]])]
        yield _rows(rows)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and benchmark item whose tiles cover at least COVERAGE of the item.

    docs has doc_id and text, items has item_id and text; other columns are ignored, whatever
    their names.  Null and empty texts, null ids and items of fewer than MIN_MATCH words match
    nothing.  Equal rows of either table give equal rows; equal items each match.  Of equally long
    matches the first in the document, then in the item, is marked first.  Very long texts are
    read whole; memory follows a text's and an item's length.  Empty tables give an empty result.

    The items go to every task in blocks of about BLOCK_BYTES of text, and the documents are
    read in place, once a block.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = size // BLOCK_BYTES + 1
    block, found = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)), []
    for k in range(n_blocks):
        rows = items.where(block == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found.append(docs.mapInArrow(partial(_scan, shared), PAIRS))
    return reduce(DataFrame.unionByName, found)


def without_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but for contaminated ones."""
    found = Scratch(spark, "leaks").keep("found", contaminated(spark, docs, items).select("doc_id").distinct())
    return without(docs, found, "doc_id")
