"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each of ``TREES`` trees orders the documents by its own run of MinHash values.  Neighbours in
that order are those with the longest common prefix.  Documents that share a tree's first values
form a region: in a small one all members are candidates of each other, in a dense one only each
member's closest neighbours, whose common prefix goes as deep as the region is dense, so that
candidates grow with the rows.  What a dense region still holds apart is then searched for by its
rarest shingles.  Every link that counts is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.scratch import Scratch
from siltstone.llm.textkit import Words, mix, name, slices

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
TREES = 24
#: Signature values a tree, as 16 bits each: the first four in ``hi``, the others in ``lo``.
DEPTH = 8
#: Documents whose first three values in a tree are equal share a region.
PREFIX_SHIFT = 16
#: A region with more members is dense.
REGION = 12
#: Neighbours on either side that are candidates in a dense region; in others, all are.
CLOSEST = 2
#: Rows (40 bytes) of a range of an order.
ROWS_A_RANGE = 1_000_000
#: Candidates whose share of equal signature bytes is lower are dropped before their sets are
#: compared: about five standard deviations below SIMILARITY_PERCENT.
SKETCH_FLOOR = 0.59
#: Up to so many ids (8 bytes each) or regions (24) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)

_SIGNED = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, sketch binary, hi array<bigint>, lo array<bigint>"
_FOUND = "kind int, tree bigint, hi bigint, lo bigint, a bigint, b bigint"
PAIR, DENSE, SEAM = range(3)


def _signature(shingles: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(values), 2048):
        out = np.minimum(out, (_MUL[:, None] * values[None, i : i + 2048] + _ADD[:, None]).min(axis=1))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in slices(batch.column("text")):
            n = end - first
            shingles, bounds = Words(raw, offsets).shingles(SHINGLE_WORDS)
            size, keys = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            signature = np.zeros((n, len(_MUL)), np.uint32)
            for d in range(n):
                if bounds[d] < bounds[d + 1]:
                    own = np.unique(shingles[bounds[d] : bounds[d + 1]])
                    size[d] = len(own)
                    keys[0, d], keys[1, d] = mix(own, 1).sum(dtype=np.uint64), mix(own, 2).sum(dtype=np.uint64)
                    signature[d] = _signature(own)
            parts = (mix(signature.reshape(n, TREES, 2, 4).astype(np.uint64), 4) >> np.uint64(48)) << np.array([48, 32, 16, 0], np.uint64)
            bounds_of = np.arange(0, (n + 1) * TREES, TREES, dtype=np.int32)
            keys_of = [pa.ListArray.from_arrays(bounds_of, pa.array(half.view(np.int64).reshape(-1))) for half in np.ascontiguousarray(np.moveaxis(parts.sum(axis=3, dtype=np.uint64), 2, 0))]
            sketch = pa.array([row.tobytes() for row in (signature & 0xFF).astype(np.uint8)], pa.binary())
            columns = [batch.column("doc_id").slice(first, n), pa.array(size), *(pa.array(k.view(np.int64)) for k in keys), sketch, *keys_of]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key1", "key2", "sketch", "hi", "lo"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
        share = (a == b).mean(axis=1)
        keep = pa.array(share >= SKETCH_FLOOR)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"]).filter(keep)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for first, end, raw, offsets in slices(column):
        shingles, bounds = Words(raw, offsets).shingles(SHINGLE_WORDS)
        for d in range(end - first):
            yield np.unique(shingles[bounds[d] : bounds[d + 1]])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(_sets(batch.column("text_a")), _sets(batch.column("text_b")), strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= SIMILARITY_PERCENT * (len(x) + len(y) - common) and common > 0)
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one column of that name); ids are broadcast only while few."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df, all columns, whose key is not in ids (one column of that name)."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti").select(*map(name, df.columns))


def _found(kind: int, tree: np.ndarray, hi: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), tree, hi, lo, a, np.zeros(len(a), np.int64) if b is None else b]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "tree", "hi", "lo", "a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIR, DENSE and SEAM rows of one sorted run of (tree, hi, lo, id).

    Rows stay at hand until REGION rows after them are known, and REGION handled rows before
    them, so that every region of more than REGION members in the run is seen to be one.
    """
    held, done, opened = np.zeros((4, 0), np.int64), 0, 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        n = held.shape[1]
        if opened < min(n, REGION):
            yield _found(SEAM, *held[:, opened : min(n, REGION)])
            opened = min(n, REGION)
        until = n if batch is None else max(done, n - REGION)
        if until > done:
            tree, hi, lo, own = held
            fresh = np.ones(n, bool)
            fresh[1:] = (tree[1:] != tree[:-1]) | (hi[1:] >> PREFIX_SHIFT != hi[:-1] >> PREFIX_SHIFT)
            region = np.cumsum(fresh) - 1
            dense = np.bincount(region)[region] > REGION
            for k in range(1, REGION):
                i = np.arange(done, min(until, n - k))
                i = i[(region[i] == region[i + k]) & (own[i] != own[i + k]) & (~dense[i] if k > CLOSEST else True)]
                yield _found(PAIR, tree[i], hi[i], lo[i], np.minimum(own[i], own[i + k]), np.maximum(own[i], own[i + k]))
            i = done + np.flatnonzero(dense[done:until])
            yield _found(DENSE, tree[i], hi[i] >> PREFIX_SHIFT, lo[i], own[i])
        if batch is None:
            yield _found(SEAM, *held[:, -REGION:])
            return
        cut = max(0, until - REGION)
        held, done = held[:, cut:], until - cut


def _candidates(signed: DataFrame, reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b: longest-common-prefix neighbours of each tree's order; (tree, prefix, id) of dense regions.

    The orders are dealt by range, ties by id, so that no region is too large for a task.  What
    lies at the two ends of each range is sorted once more, so that no neighbours are parted.
    """
    spark, order = signed.sparkSession, ["tree", "hi", "lo", "id"]
    own = scratch.keep("trees", semi_join(signed.where("n_shingles > 0"), reps, "doc_id").select(F.col("doc_id").alias("id"), "hi", "lo"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.count() * TREES // ROWS_A_RANGE)
    rows = own.select("id", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "z")).select(F.col("tree").cast("bigint").alias("tree"), "z.hi", "z.lo", "id")
    found = scratch.keep("near", rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND))
    turn, last = 0, found
    while parts > 1:
        # 2 * REGION rows a range at most, in ranges of their own until one holds all
        turn += 1
        ends = scratch.keep(f"ends{turn}", last.where(F.col("kind") == SEAM).select("tree", "hi", "lo", F.col("a").alias("id")).distinct())
        parts = min(parts - 1, 1 + ends.count() // ROWS_A_RANGE)
        sorted_ = (ends.repartitionByRange(parts, *order) if parts > 1 else ends.repartition(1)).sortWithinPartitions(*order)
        last = scratch.keep(f"seams{turn}", sorted_.mapInArrow(_neighbours, _FOUND))
        found = found.unionByName(last)
    pairs = scratch.keep("candidates", found.where(F.col("kind") == PAIR).select("a", "b").distinct())
    dense = scratch.keep("dense", found.where(F.col("kind") == DENSE).select("tree", F.col("hi").alias("prefix"), F.col("a").alias("id")).distinct())
    scratch.drop("trees", "near", *(f"{t}{i + 1}" for t in ("ends", "seams") for i in range(turn)))
    return pairs, dense


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for first, end, raw, offsets in slices(batch.column("text")):
            shingles, bounds = Words(raw, offsets).shingles(SHINGLE_WORDS)
            own = [np.unique(shingles[bounds[d] : bounds[d + 1]]) for d in range(end - first)]
            sizes = [len(x) for x in own]
            columns = [np.repeat(ids[first:end], sizes), np.repeat(sizes, sizes).astype(np.int64), np.concatenate(own).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "n", "shingle"])


def _class(size: Column) -> Column:
    """Sizes by classes, each a twentieth larger than the one before."""
    return F.floor(F.log(size.cast("double")) / math.log(1.05)).cast("int")


def _partners(n: str, i: str) -> Column:
    """Classes of sizes that a document of n shingles can be linked with if the i-th of them is the first shared one.

    The overlap that a link needs grows with the other's size, and what follows the shared shingle
    bounds it: the later it stands, the smaller the other must be.
    """
    size = F.col(n)
    least = F.ceil(SIMILARITY_PERCENT * size / 100)
    most = F.least(F.floor(100 * size / SIMILARITY_PERCENT), F.floor((size - F.col(i) + 1) * (100 + SIMILARITY_PERCENT) / SIMILARITY_PERCENT) - size)
    return F.when(most >= least, F.sequence(_class(F.greatest(least, F.lit(1))), _class(F.greatest(most, F.lit(1)))))


def _met(index: DataFrame) -> DataFrame:
    """Entries of ``index`` with those that ask (u, m, j, at_u) for the same shingle, dealt by both sizes.

    Each side goes to the classes that the other's size may have, so that a shingle that very many
    documents of one size share late in their order meets nothing there.
    """
    asked = index.where("asks").select(F.col("id").alias("u"), F.col("n").alias("m"), F.col("at").alias("at_u"), F.col("i").alias("j"), "shingle")
    asked = asked.withColumns({"cm": _class(F.col("m")), "cn": F.explode(_partners("m", "j"))})
    return asked.join(index.withColumns({"cn": _class(F.col("n")), "cm": F.explode(_partners("n", "i"))}), ["shingle", "cn", "cm"])


def _unread(docs: DataFrame, dense: DataFrame, component: Callable[[str], DataFrame], scratch: Scratch) -> DataFrame | None:
    """(a, b) that dense regions may have kept apart: the exact way for what their neighbours leave.

    Two documents of one dense region are joined if both are in the component that has most of
    its members.  So only members that are not need a search, against all members of regions
    that hold several components.  It is complete: in the order from rarest to most common
    shingle, two similar sets share a first one, and what follows it in both suffices for the
    overlap that the link needs.  What is most common stands last in that order, so that no posting
    list of a shared passage is met.  None if there is nothing to search.
    """
    placed = scratch.keep("placed", dense.join(component("id"), "id", "left").withColumn("at", F.coalesce("at_id", "id")).drop("at_id"))
    tally = placed.groupBy("tree", "prefix", "at").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("tree", "prefix").agg(F.count("*").alias("k"), F.max_by("at", F.struct("n", -F.col("at"))).alias("main")).where("k > 1").drop("k")
    mixed = scratch.keep("regions", mixed)
    if mixed.count() <= BROADCAST_IDS:  # a large region's members then stay where they are
        mixed = F.broadcast(mixed)
    inside = scratch.keep("mixed", placed.join(mixed, ["tree", "prefix"]).groupBy("id", "at").agg(F.max(F.col("at") != F.col("main")).alias("asks")))
    if inside.isEmpty():
        return None
    texts = semi_join(docs, inside.select(F.col("id").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = scratch.keep("shingled", texts.mapInArrow(_shingled, "id bigint, n bigint, shingle bigint"))
    spread = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    rarest = Window.partitionBy("id").orderBy("df", "shingle")
    # shingles of one document alone stand first and are met by none
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    index = rows.join(spread, "shingle").withColumn("i", alone + F.row_number().over(rarest)).where(F.col("i") <= F.col("n") - F.ceil(SIMILARITY_PERCENT * F.col("n") / 100) + 1)
    index = scratch.keep("index", index.join(inside, "id").select("id", "n", "shingle", "i", "at", "asks"))
    overlap = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + 1
    near = (F.col("at") != F.col("at_u")) & (overlap * (100 + SIMILARITY_PERCENT) >= SIMILARITY_PERCENT * (F.col("n") + F.col("m")))
    pairs = _met(index).where(near).select(F.least("id", "u").alias("a"), F.greatest("id", "u").alias("b")).distinct()
    scratch.drop("shingled", "placed", "regions")
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()


def _sketched(pairs: DataFrame, signed: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """a, b and share of the pairs whose sketches do not rule out a link."""
    sketches = scratch.keep(table, semi_join(signed.select("doc_id", "sketch"), _ends(pairs), "doc_id").groupBy("doc_id").agg(F.first("sketch").alias("sketch")))
    side = lambda c: sketches.withColumnsRenamed({"doc_id": c, "sketch": f"sketch_{c}"})
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely, "a bigint, b bigint, share double")


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    texts = scratch.keep(table, semi_join(docs, _ends(pairs), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    side = lambda c: texts.withColumnsRenamed({"doc_id": c, "text": f"text_{c}"})
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a bigint, b bigint")


def _joined(spark: SparkSession, found: DataFrame, links: DataFrame, scratch: Scratch, turn: str) -> DataFrame:
    """Components (id, component) after further links."""
    if links.isEmpty():
        return found
    edges = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return scratch.keep(f"components{turn}", connected_components(spark, edges, scratch, f"round{turn}"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    A document's set is that of its distinct 5-word shingles of words ``[^\\x20\\x09-\\x0D]+``
    after A-Z are lower-cased; with fewer words, its whole sequence.  Documents whose sets have
    a Jaccard similarity of at least 75 % are linked; component_id is the smallest doc_id in
    reach, and kept says that it is the document's own.

    Null or empty text, or text without words, has an empty set, is linked with nothing and is
    kept.  Rows with equal doc_id are each placed by their own text, whose links are confirmed
    on the smallest of the texts.  A null doc_id is in no component (component_id null) and is
    kept.  Very long texts are read whole: a text's set takes 8 bytes a shingle while it is
    signed.  Ties in an order are broken by doc_id, so that reruns agree.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.

    Equal sets collapse to their smallest doc_id first.  Candidates are then confirmed in
    rounds: first the likeliest link of each document to a smaller one, then every candidate
    whose ends the first round has not already joined, then what dense regions kept apart.
    No candidate is left out otherwise.
    """
    scratch = Scratch(spark, "near")
    docs = docs.select("doc_id", "text")
    signed = scratch.keep("signed", docs.mapInArrow(_sign, _SIGNED))
    sets = signed.where("n_shingles > 0 and doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    sets = scratch.keep("sets", sets)
    reps = sets.select(F.col("rep").alias("doc_id")).distinct()
    candidates, dense = _candidates(signed, reps, scratch)
    likely = scratch.keep("likely", _sketched(candidates, signed, scratch, "sketches"))
    scratch.drop("candidates", "sketches")
    first = scratch.keep("first", likely.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a")))
    links = scratch.keep("links1", _verified(first, docs, scratch, "texts1"))
    found = scratch.keep("components1", connected_components(spark, links, scratch, "round1"))

    def component(c: str) -> DataFrame:
        return found.select(F.col("id").alias(c), F.col("component").alias(f"at_{c}"))

    def still_apart(pairs: DataFrame) -> DataFrame:
        return pairs.join(component("a"), "a", "left").join(component("b"), "b", "left").where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b"))

    rest = scratch.keep("rest", still_apart(likely.join(first, ["a", "b"], "left_anti")))
    found = _joined(spark, found, scratch.keep("links2", _verified(rest, docs, scratch, "texts2")), scratch, "2")
    beside = _unread(docs, dense, component, scratch)
    if beside is not None:
        beside = scratch.keep("beside", beside)
        beside = scratch.keep("likely3", _sketched(beside, signed, scratch, "sketches3"))
        found = _joined(spark, found, scratch.keep("links3", _verified(beside, docs, scratch, "texts3")), scratch, "3")
    scratch.drop("first", "rest", "texts1", "texts2", "texts3", "likely", "likely3", "sketches3", "beside", "mixed", "dense", "index")
    named = sets.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    whole = signed.select("doc_id", "n_shingles", "key1", "key2")
    if_linked = whole.where("n_shingles > 0 and doc_id is not null").join(named, ["key1", "key2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    alone = whole.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return if_linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but for near copies of a document with a smaller doc_id."""
    dropped = Scratch(spark, "copies").keep("dropped", near_duplicates(spark, docs).where("not kept").select("doc_id").distinct())
    return without(docs, dropped, "doc_id")

#: DuckDB SQL of near_duplicates() over documents with distinct doc_ids: every pair that shares a shingle.
NEAR_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS s
  FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= {SIMILARITY_PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SIMILARITY_PERCENT} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT e.b, r.x FROM reach r JOIN edges e ON e.a = r.id WHERE r.x < e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.x AS component_id, m.x = s.doc_id AS kept FROM sets s JOIN (SELECT id, min(x) AS x FROM reach GROUP BY id) m ON m.id = s.doc_id
"""
