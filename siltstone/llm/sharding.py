"""Contiguous shards of equal bytes from global prefix sums of partition totals.

Documents are ordered by the hash of their text.  Ranges of that order, of about BUCKET_ROWS rows each,
are the partitions whose totals are summed; a text whose copies make up more than a stated part of all
bytes or rows has partitions of its own, as many as its share asks for, so that no task holds a
large part of the rows.  Their number is bounded, so the table of totals is small at any input size.
The running sums over the totals, cut at equal targets, give the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.textkit import beside, nested

BUCKET_ROWS = 1 << 14
#: Ranges are 2 to a power between these, so that their totals can be broadcast (32 bytes each).
LEAST_BITS, MOST_BITS = 6, 20
#: A text whose copies have at most this part of a shard's bytes goes whole into the shard that
#: holds its middle, so that equal texts stay together; a larger one is cut between documents.
WHOLE_PART = 32


def range_bits(n_rows: int) -> int:
    """The leading bits of a hash that tell its range."""
    return min(MOST_BITS, max(LEAST_BITS, (n_rows // BUCKET_ROWS).bit_length()))


def shard(docs: DataFrame, n_shards: int, size: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """docs, but for the columns ``without``, with size, shard (0 to n_shards - 1) and slot (its place there, gapless from 0).

    Shards are contiguous in the order of text hash and doc_id and of near-equal size sums.
    Equal texts share a shard unless together they exceed 1/WHOLE_PART of one.  Null text has a
    hash like any other; rows with equal text, doc_id and size, repeated ones too, each get a slot, in any
    order; a very long text counts as one row; an empty table gives an empty result.  Columns of docs
    named size, shard or slot are replaced, other names don't clash.
    """
    scratch, part = Scratch(docs.sparkSession, "shards"), n_shards * WHOLE_PART
    hashed = docs.select(nested(docs, "size", "shard", "slot", *without), size.cast("long").alias("size"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    texts = scratch.keep("texts", hashed.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("z")))
    every = texts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n"), F.greatest(F.sum("z"), F.lit(1)).alias("z")).first()
    shares = F.greatest(F.ceil(F.col("n") * part / every["n"]), F.ceil(F.col("z") * part / every["z"]))
    # more than one share: 2 * part texts at most, with 3 * part shares
    heavy = scratch.keep("heavy", texts.where((F.col("n") * part > every["n"]) | (F.col("z") * part > every["z"])).select("h", shares.alias("shares")))
    marked = hashed.join(F.broadcast(heavy), "h", "left").withColumns({
        "bucket": F.shiftrightunsigned("h", 64 - range_bits(every["n"])),
        "own": F.when(F.col("shares").isNotNull(), F.col("h")).otherwise(0),
        "salt": F.when(F.col("shares").isNotNull(), 1 + F.pmod(F.xxhash64("id", "h"), F.col("shares"))).otherwise(0),
    }).drop("shares")
    key = ["bucket", "own", "salt"]
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    text = Window.partitionBy("bucket", "own")
    cells = marked.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("z")).select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("z").over(before), F.lit(0)).alias("byte0"), F.sum("z").over(text).alias("text_size"),
    )
    cells = scratch.keep("cells", cells.withColumn("text0", F.min("byte0").over(text)))
    scratch.drop("texts")
    cell = Window.partitionBy(*key).orderBy("h", "id", "size")
    copies = Window.partitionBy(*key, "h")
    placed = marked.withColumns({"rn": F.row_number().over(cell), "at": F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    placed = placed.withColumns({"at0": F.min("at").over(copies), "copies_size": F.sum("size").over(copies)}).join(F.broadcast(cells), key)
    # twice the middle, in whole numbers: of all copies, or of the one document of a text that is cut
    middle = (
        F.when(F.col("salt") == 0, 2 * (F.col("byte0") + F.col("at0")) + F.col("copies_size"))
        .when(F.col("text_size") * part <= every["z"], 2 * F.col("text0") + F.col("text_size"))
        .otherwise(2 * (F.col("byte0") + F.col("at")) + F.col("size"))
    )
    placed = placed.withColumns({"shard": F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * every["z"]))).cast("int"), "rank": F.col("rank0") + F.col("rn") - 1})
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))
    placed = placed.join(F.broadcast(starts), "shard")
    return beside(placed, "size", "shard", (F.col("rank") - F.col("start")).alias("slot"))


def text_bytes() -> Column:
    """UTF-8 bytes of the text (null: none) plus 1, so that empty documents count."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shard_digest(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; sizes are text_bytes().

    A null text has the size 1 and no checksum.  Extra columns are ignored; see shard() for ties.
    """
    out = shard(docs.select("doc_id", "text", F.crc32("text").alias("text_crc32")), n_shards, text_bytes(), ("text",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
