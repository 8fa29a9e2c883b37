"""Alignment of two tokenizers' tokens over a corpus, each distinct segment aligned once.

Texts are cut before runs of white space that neither vocabulary can merge across.  Tasks number
the distinct segments of a slice of documents, so that a document becomes a list of small
numbers and only the distinct segments of slices are shuffled.  Sorted by segment, equal ones
of all slices lie together, are tokenized and aligned once and take their alignment back to their slices,
where documents are composed from it.  No segment comes more often than there are slices, so no
key is hot.  Every cut is an end of tokens on both sides, so the groups of a text are those of
its segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.segments import gathered, joined_pairs, segment_starts, string_array
from siltstone.llm.textkit import slices
from siltstone.llm.tokens import ByteLevel, Pieces, sizes, vocabulary

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Documents are numbered in slices of about this many bytes.
SLICE_BYTES = 1 << 23
#: Segments go to the tokenizers in blocks of about this many bytes.
BLOCK_BYTES = 1 << 20
#: Counts of up to this many id pairs (17 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_PAIRS = 4_000_000

_NUMBERED = pa.schema([("slice", pa.int64()), ("code", pa.int32()), ("segment", pa.large_string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.large_binary())])
_ALIGNED = pa.schema([("slice", pa.int64()), ("code", pa.int32()), ("n", pa.int64()), ("n_a", pa.int32()), ("groups", pa.large_string()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
_DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"


def numbered(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Rows of two kinds: the distinct segments of a slice (code, segment, n) and its documents (doc_id, codes).

    A document whose text is null or empty, or has a character that B doesn't give back, has null
    codes and counts nowhere.  A slice lies within a task and is numbered after it.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(a, plain=True), Pieces(b)
        joined = joined_pairs(left.entries) | joined_pairs(right.entries)
        kept: dict[str, bool] = {}
        at = TaskContext.get().partitionId() << 32
        for ids, texts in gathered(batches, SLICE_BYTES):
            alive = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
            front = pc.if_else(pa.array(alive), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
            spaced = pc.binary_join_element_wise(front, pc.fill_null(texts, ""), pa.scalar("", pa.large_string()))
            del texts
            for first, end, raw, offsets in slices(spaced, 1 << 62, len(spaced)):
                starts = segment_starts(raw, offsets, joined)
                coded = string_array(raw, starts).dictionary_encode()
                values, codes = coded.dictionary, coded.indices.to_numpy()
                bounds = np.searchsorted(starts, offsets)
                letters = set().union(*(part.tobytes().decode() for _, _, part, _ in slices(values)))
                kept |= {c: right.keeps(c) for c in letters - kept.keys()}
                if lost := [c for c in letters if not kept[c]]:
                    bad = np.zeros(len(values), bool)
                    for c in lost:
                        bad |= pc.match_substring(values, c).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(end - first), np.diff(bounds))
                    alive[np.unique(row[bad[codes]])] = False
                    counts = np.bincount(codes[alive[row]], minlength=len(values))
                else:
                    counts = np.bincount(codes, minlength=len(values))
                # frequent segments have small codes
                order = np.argsort(-counts, kind="stable")
                codes, n, m = np.argsort(order)[codes], int(np.count_nonzero(counts)), end - first
                packed = pa.array([_packed(codes[i:j]) if live else None for i, j, live in zip(bounds, bounds[1:], alive, strict=False)], pa.large_binary())
                yield from _batches([pa.array(np.full(n, at)), pa.array(np.arange(n, dtype=np.int32)), values.take(pa.array(order[:n])), pa.array(counts[order[:n]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.large_binary())])
                yield from _batches([pa.array(np.full(m, at)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.large_string()), pa.nulls(m, pa.int64()), ids, packed])
                at += 1
            # the next slice, and whatever the worker does next, starts without this one
            del spaced, raw, starts, coded, values, codes, packed
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(number, "slice bigint, code int, segment string, n bigint, doc_id bigint, codes binary")


def _packed(codes: np.ndarray) -> bytes:
    """The codes' number, then their bytes by place, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _batches(columns: list[pa.Array], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, schema=_NUMBERED)
    for i in range(0, len(whole), rows):
        yield whole.slice(i, rows)


def aligned(segments: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Rows (slice, code, segment, n) with their segment's count of A tokens, groups as text, and linked ids a and b.

    A group ends where tokens of both end; its last two tokens are the link.  Ids that do not spell
    their segment are an error: numbered() leaves out the characters that could make some.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(a, plain=True), Pieces(b)
        size_a, size_b = sizes(left.entries), sizes(right.entries)
        last: tuple = (None, None)  # a segment may go on in the next batch
        for batch in batches:
            coded = batch.column("segment").dictionary_encode()
            segments = coded.dictionary.to_pylist()
            todo = segments[1:] if segments[0] == last[0] else segments
            texts = [s.encode() for s in todo]
            ends = np.cumsum([0] + [len(t) for t in texts])
            found = [last[1]] if len(todo) < len(segments) else []
            for i, j in _blocks(ends):
                found += _aligned_block(todo[i:j], b"".join(texts[i:j]), ends[i : j + 1] - ends[i], left, right, size_a, size_b)
            last = segments[-1], found[-1]
            values = [pa.array(column, f.type) for column, f in zip(zip(*found, strict=True), list(_ALIGNED)[3:], strict=True)]
            columns = [batch.column(c) for c in ("slice", "code", "n")] + [v.take(coded.indices) for v in values]
            yield pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)

    spread = segments.select("slice", "code", "n", "segment").repartition("segment").sortWithinPartitions("segment")
    return spread.mapInArrow(align, "slice bigint, code int, n bigint, n_a int, groups string, a array<int>, b array<int>")


def _blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of segments of about BLOCK_BYTES."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j
        i = j


def _aligned_block(segments: list[str], raw: bytes, offsets: np.ndarray, left: ByteLevel, right: Pieces, size_a: np.ndarray, size_b: np.ndarray) -> list[tuple]:
    """(n_a, groups, a, b) of each segment, from the ends of all their tokens at once."""
    by_a, by_b = left.encode(segments), right.encode(segments)
    ids_a, ids_b = (np.fromiter((t for s in x for t in s), np.int64) for x in (by_a, by_b))
    if b"".join(left.entries[t] for t in ids_a) != raw or b"".join(right.entries[t] for t in ids_b) != raw:
        raise ValueError("a vocabulary does not give back the bytes of a segment")
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    links = np.searchsorted(both, offsets, "right").tolist()  # the bounds of each segment
    texts = _group_texts(ids_a.tolist(), ids_b.tolist(), at_a.tolist(), at_b.tolist(), links)
    link_a, link_b = ids_a[at_a].tolist(), ids_b[at_b].tolist()
    return [(len(x), text, link_a[i:j], link_b[i:j]) for x, text, i, j in zip(by_a, texts, links, links[1:], strict=False)]


def _group_texts(ids_a: list, ids_b: list, at_a: list, at_b: list, links: list) -> list[str]:
    """`a1,a2|b1;a3|b2` of each segment."""
    spell = lambda ids: ",".join(map(str, ids))
    from_a, from_b, groups = 0, 0, []
    for i, j in zip(at_a, at_b, strict=True):
        groups.append(f"{spell(ids_a[from_a : i + 1])}|{spell(ids_b[from_b : j + 1])}")
        from_a, from_b = i + 1, j + 1
    return [";".join(groups[i:j]) for i, j in zip(links, links[1:], strict=False)]


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(a, b, pairs): how many links of the corpus hold an id pair."""
    return alignments.select("n", F.explode(F.arrays_zip("a", "b")).alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("pairs"))


def with_best(pairs: DataFrame) -> DataFrame:
    """pairs with ``best``: whether no pair of b has more links; there are at most as many such counts as B has ids."""
    highest = pairs.groupBy("b").agg(F.max("pairs").alias("highest"))
    return pairs.join(F.broadcast(highest), "b").select("a", "b", "pairs", (F.col("pairs") == F.col("highest")).cast("int").alias("best"))


def with_counts(alignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """alignments (slice, code, n_a, groups, a, b) with n_best and count_sum in place of a and b.

    The pairs' counts go to every executor up to BROADCAST_PAIRS; more are joined to the exploded links.
    """
    kept = alignments.select("slice", "code", "n_a", "groups", "a", "b")
    if pairs.count() > BROADCAST_PAIRS:
        rows = kept.withColumn("key", F.struct("slice", "code"))
        links = rows.select("key", F.explode(F.arrays_zip("a", "b")).alias("l")).select("key", "l.a", "l.b").join(pairs, ["a", "b"])
        return rows.drop("a", "b").join(links.groupBy("key").agg(F.sum("best").alias("n_best"), F.sum("pairs").alias("count_sum")), "key").drop("key")
    table = pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "pairs", F.col("best").cast("boolean")).toPandas().sort_values("key")
    keys, counts, best = (table[c].to_numpy() for c in ("key", "pairs", "best"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column("a")).to_numpy()
            key = (batch.column("a").flatten().to_numpy().astype(np.int64) << 32) + batch.column("b").flatten().to_numpy()
            at, ends = np.searchsorted(keys, key), np.cumsum(n)
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, counts)]
            more = [pa.array(s[ends] - s[ends - n]) for s in sums]
            names = ["slice", "code", "n_a", "groups"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, names=[*names, "n_best", "count_sum"])

    return kept.mapInArrow(look_up, "slice bigint, code int, n_a int, groups string, n_best bigint, count_sum bigint")


def align_tokenizers(spark: SparkSession, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """One row for every row of docs (doc_id, text), of which other columns are ignored: counts and groups_sha256.

    Texts are taken with one space in front; strings of special tokens in them are plain text.  A text
    that is null or empty, or that B does not give back byte for byte, has zeros and an empty
    hash.  Equal texts and repeated rows each have a row; null doc_ids stay; a very long text is one
    slice of its own; an empty table gives an empty result.  ``n_best`` counts links whose pair is
    the most frequent of its B id in the corpus, ties included, and ``count_sum`` adds the
    frequencies of all links.  With ``keep_groups`` the groups themselves are a column too.
    """
    a, b = vocabulary(VOCABULARY_A, path_a), vocabulary(VOCABULARY_B, path_b)
    scratch = Scratch(spark, "alignment")
    rows = scratch.keep("numbered", numbered(docs, a, b))
    alignments = scratch.keep("aligned", aligned(rows.where("segment IS NOT NULL"), a, b))
    pairs = with_best(scratch.keep("pairs", pair_counts(alignments)))
    back = with_counts(alignments, pairs).withColumnRenamed("slice", "part")
    documents = rows.where("segment IS NULL").select("slice", "doc_id", "codes")
    text = ", groups string" if keep_groups else ""
    return documents.groupBy("slice").cogroup(back.groupBy("part")).applyInArrow(_composer(keep_groups), f"{_DIGEST}, groups_sha256 string{text}")


def _composer(keep_groups: bool):

    def compose(documents: pa.Table, segments: pa.Table) -> pa.Table:
        """The documents of a slice from the alignments of its distinct segments."""
        code = segments["code"].to_numpy()
        place = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        place[code] = np.arange(len(code))
        lists = [None if c is None else place[_unpacked(c)] for c in documents["codes"].to_pylist()]
        n_codes = np.array([0 if x is None else len(x) for x in lists])
        at = np.concatenate([np.zeros(0, np.int64), *(x for x in lists if x is not None)])
        ends = np.cumsum(n_codes)
        out = {"doc_id": documents["doc_id"]}
        # a group has one | and, among its tokens, one comma less on either side
        n_groups = pc.count_substring(segments["groups"], "|").to_numpy().astype(np.int64)
        tokens = pc.count_substring(segments["groups"], ",").to_numpy().astype(np.int64) + 2 * n_groups
        own = {c: segments[c].to_numpy().astype(np.int64) for c in ("n_a", "n_best", "count_sum")}
        for name, each in (own | {"n_b": tokens - own["n_a"], "n_groups": n_groups}).items():
            total = np.concatenate([[0], np.cumsum(each[at])])
            out[name] = pa.array(total[ends] - total[ends - n_codes])
        groups = segments["groups"].to_pylist()
        hashes, told = [], []
        for x in lists:
            text = "" if x is None else ";".join([groups[i] for i in x.tolist()])
            hashes.append("" if x is None else hashlib.sha256(text.encode()).hexdigest())
            if keep_groups:
                told.append(text)
        out["groups_sha256"] = pa.array(hashes)
        if keep_groups:
            out["groups"] = pa.array(told)
        out["n_links"] = out["n_groups"]
        order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + (["groups"] if keep_groups else [])
        return pa.table({c: out[c] for c in order})

    return compose


def alignment_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and groups_sha256 of every row of docs; see align_tokenizers()."""
    return align_tokenizers(spark, docs)
