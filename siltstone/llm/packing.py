"""Best-fit packing of token pieces into sequences of a fixed length.

Documents become token ids and an end token; longer ones than a sequence are cut into full pieces
after a first piece that may be shorter.  What has to be packed is then a histogram of at most
``capacity`` lengths, whatever the input's size.  Its configuration linear program (how often is each
way to fill a sequence used) is solved by multiplicative weights: lengths that lag behind in
coverage gain weight, knapsack dynamic programming prices the fillings, and all near-best ones
are used a little more.  The solution is rounded down (fillings that waste nothing first), the rest is
solved again, and what is left at the end is put where it fits best: some thousand pieces, as
many as there are fillings, however large the input.
Pieces are numbered within their length in parallel and look up their place in the plan.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.segments import gathered, joined_pairs, segment_starts, string_array
from siltstone.llm.textkit import slices
from siltstone.llm.tokens import ByteLevel, sizes, vocabulary

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Tasks tokenize the distinct segments of about so many bytes of documents, in parts of about so many.
SLICE_BYTES = 1 << 24
PART_BYTES = 1 << 20
#: Accuracy of the linear program, and how often the rest of a rounding is solved again.
EPSILON = 0.4
LEVELS = 3
#: Fillings that waste room are used so many times less, which leaves a rest that fits well.
SPARE = 4
#: Pieces are numbered in cells of at most 2 ** CELL_BITS written rows.
CELL_BITS = 20
#: Ranks within a length are below 2 ** RANK_BITS.
RANK_BITS = 44

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary_bytes: bytes, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): PIECE and, with ``keep_ids``, their ids.

    A null text is an empty one and gives the end token alone.  Repeated rows give their pieces each.
    Texts are tokenized by segments, cut where the result is the same; a very long one is a slice of its own.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteLevel(vocabulary_bytes, plain=False)
        joined = joined_pairs(model.entries)
        for doc_ids, texts in gathered(batches, SLICE_BYTES):
            for first, end, raw, offsets in slices(texts, 1 << 62, len(texts)):
                ids, bounds = _encoded(model, joined, raw, offsets)
                out = [[] for _ in schema]
                for doc_id, i, j in zip(doc_ids[first:end].to_pylist(), bounds, bounds[1:], strict=False):
                    whole = np.append(ids[i:j], end_id).astype("<u4")
                    head = (len(whole) - 1) % capacity + 1
                    for piece, stop in enumerate(range(head, len(whole) + 1, capacity)):
                        start = stop - capacity if piece else 0
                        part = whole[start:stop]
                        values = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))
                        for column, value in zip(out, values, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE + (", ids array<int>" if keep_ids else ""))


def _encoded(model: ByteLevel, joined: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a slice, one after the other, and the bounds of each; distinct segments are encoded once."""
    starts = segment_starts(raw, offsets, joined)
    coded = string_array(raw, starts).dictionary_encode()
    codes, (known, first) = coded.indices.to_numpy(), _encoded_segments(model, joined, coded.dictionary)
    n = np.diff(first)[codes]
    ends = np.cumsum(n)
    ids = known[np.repeat(first[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.append(0, ends)[np.searchsorted(starts, offsets)]


def _encoded_segments(model: ByteLevel, joined: np.ndarray, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct segments and the bounds of each.

    Segments that stand between cuts when written one after the other are encoded as one text, in
    parts, and told apart by the bytes of their ids; the few others are encoded alone.
    """
    _, _, raw, offsets = next(slices(segments, 1 << 62, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    is_cut = np.isin(offsets, segment_starts(raw, np.zeros(1, np.int64), joined))
    is_cut[-1:] = True
    in_line = is_cut[:-1] & is_cut[1:]
    # any segment may come to stand before any other: none whose last byte some entry joins to an opening one
    opening = np.unique(raw[offsets[:-1][in_line]])
    in_line &= ~joined[:, opening].any(1)[raw[offsets[1:] - 1]]
    size = sizes(model.entries)
    found: list[np.ndarray] = []
    counts = np.zeros(len(in_line), np.int64)
    order = []
    rest = np.flatnonzero(in_line)
    while len(rest):
        lengths = np.cumsum(offsets[rest + 1] - offsets[rest])
        k = max(1, int(np.searchsorted(lengths, PART_BYTES, "right")))
        part, rest = rest[:k], rest[k:]
        text = "".join(segments.take(pa.array(part)).to_pylist())
        ids = np.array(model.encode([text])[0], np.uint32)
        last = np.searchsorted(np.cumsum(size[ids]), lengths[:k] if len(lengths) else lengths)
        counts[part] = np.diff(np.append(-1, last))
        found.append(ids)
        order.append(part)
    alone = np.flatnonzero(~in_line)
    for i in range(0, len(alone), 1000):
        part = alone[i : i + 1000]
        for s, ids in zip(part, model.encode(segments.take(pa.array(part)).to_pylist()), strict=True):
            counts[s] = len(ids)
            found.append(np.array(ids, np.uint32))
        order.append(part)
    order = np.concatenate([np.zeros(0, np.int64), *order]).astype(np.int64)
    # back into the order of the segments
    at = np.zeros(len(counts), np.int64)
    at[order] = np.cumsum(counts[order]) - counts[order]
    first = np.append(0, np.cumsum(counts))
    flat = np.concatenate([np.zeros(0, np.uint32), *found])
    return flat[np.repeat(at - first[:-1], counts) + np.arange(first[-1])], first


Pattern = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size up to capacity the dearest filling, and the index of one length in it (-1: none).

    ``lengths`` ascend; any number of each may be used.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], choice[c - 1] if best[c - 1] > 0 else -1
        if k := upto[c]:
            values = prices[:k] + best[c - lengths[:k]]
            top = int(values.argmax())
            if values[top] >= best[c]:
                best[c], choice[c] = values[top], top
    return best, choice


def _filling(first: int, lengths: np.ndarray, best: np.ndarray, choice: np.ndarray, capacity: int) -> Pattern:
    """The dearest filling that holds the length at ``first``, as (index, times) pairs."""
    counts, left = Counter([first]), capacity - int(lengths[first])
    while left > 0 and choice[left] >= 0:
        took = int(choice[left])
        counts[took] += 1
        left -= int(lengths[took])
    return tuple(sorted(counts.items()))


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int, epsilon: float = EPSILON) -> dict[Pattern, float]:
    """How often each filling is used, so that every length is covered; near the least total.

    Weights fall with the share of a length's demand that is covered.  Each round prices the
    fillings by knapsack, takes for every length the dearest filling with it if it is within
    epsilon of the best, and raises those, dearest first, until a length has been covered by
    1/alpha in that round.
    """
    m = len(lengths)
    alpha = math.log(m + 1) / epsilon
    covered, used = np.zeros(m), Counter()
    while (least := covered.min()) < 1:
        prices = lengths * np.exp(-alpha * (covered - least))
        best, choice = knapsack(lengths, prices, capacity)
        values = prices + best[capacity - lengths]
        near = np.flatnonzero(values >= (1 - epsilon) * values.max())
        room = (demand / alpha).tolist()
        for first in near[np.argsort(-values[near], kind="stable")].tolist():
            if room[first] > 0:
                filling = _filling(first, lengths, best, choice, capacity)
                if (step := min(room[s] / n for s, n in filling)) > 0:
                    used[filling] += step
                    for s, n in filling:
                        room[s] -= step * n
        covered += 1 / alpha - np.array(room) / demand
    return used


@dataclass
class Plan:
    """Fillings and how often they are used, in order; the sequences are numbered along them."""

    capacity: int
    uses: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending keys (length and first rank), with the sequence of that rank and the offset, of runs of pieces."""
        next_rank, first, rows = Counter(), 0, []
        for filling, times in self.uses:
            offset = 0
            for length in filling:
                rows.append(((length << RANK_BITS) + next_rank[length], first, offset))
                next_rank[length] += times
                offset += length
            first += times
        rows.sort()
        keys, sequences, offsets = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        return keys, sequences, offsets

    @property
    def n_sequences(self) -> int:
        return sum(times for _, times in self.uses)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, epsilon: float = EPSILON) -> Plan:
    """The plan for so many pieces of each length; an empty histogram gives an empty plan."""
    plan = Plan(capacity)
    rest = Counter({length: n for length, n in histogram.items() if n > 0})
    if full := rest.pop(capacity, 0):
        plan.uses.append(((capacity,), full))
    for level in range(LEVELS):
        # a length takes part while there are enough pieces of it for any filling; the few others fill gaps
        if not (many := sorted(n for n in rest if rest[n] >= capacity // n)):
            break
        lengths = np.array(many)
        demand = np.array([rest[int(n)] for n in lengths], float)
        found = configuration_lp(lengths, demand, capacity, epsilon)
        waste = {p: capacity - sum(int(lengths[s]) * n for s, n in p) for p in found}
        for p in sorted((p for p in found if level == LEVELS - 1 or not waste[p]), key=lambda p: (waste[p], -found[p], p)):
            spare = SPARE if waste[p] else 0
            times = min([max(0, math.floor(found[p] + 1e-9) - spare), *(rest[int(lengths[s])] // n for s, n in p)])
            if times:
                plan.uses.append((tuple(int(lengths[s]) for s, n in p for _ in range(n)), times))
                for s, n in p:
                    rest[int(lengths[s])] -= times * n
        rest = +rest
    plan.uses.extend((filling, 1) for filling in best_fit(rest, capacity))
    return plan


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Pieces, longest first, each into the fullest sequence that it fits."""
    open_at: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    done = []
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            room = next((r for r in range(length, capacity + 1) if open_at[r]), None)
            sequence = open_at[room].pop() if room is not None else []
            sequence.append(length)
            left = (capacity if room is None else room) - length
            if left:
                open_at[left].append(sequence)
            else:
                done.append(tuple(sequence))
    return done + [tuple(s) for bucket in open_at for s in bucket]


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, path: str | None = None) -> DataFrame:
    """The pieces of docs (see pieces()) with sequence_id and offset, their place in a sequence.

    Offsets of a sequence are gapless from 0 and its lengths add up to ``capacity`` at most.  Other
    columns of docs are ignored, whatever their names; equal pieces, of repeated rows too, have
    a place each; null doc_ids are kept; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    numbered = pieces(docs, vocabulary(VOCABULARY, path), capacity, end_id, keep_ids).withColumn("row", F.monotonically_increasing_id())
    made = scratch.keep("pieces", numbered).withColumn("cell", F.shiftright("row", CELL_BITS))
    cells = scratch.keep("cells", made.groupBy("length", "cell").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    keys, sequences, offsets = plan_packing(histogram, capacity).lookup()

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length, rank):
        key = (length.to_numpy(np.int64) << RANK_BITS) + rank.to_numpy(np.int64)
        at = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + key - keys[at], "offset": offsets[at]})

    ahead = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "cell").orderBy("row")
    ranked = made.select("row", "length", "cell") if keep_ids else made
    ranked = ranked.withColumn("rn", F.row_number().over(inner) - 1).join(before, ["length", "cell"])
    placed = ranked.withColumn("place", place("length", F.col("before") + F.col("rn")))
    if keep_ids:
        placed = placed.select("row", "place").join(made, "row")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pack() with its ids; a sequence has ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packing_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; see pack()."""
    return pack(spark, docs)
