"""A time-varying mix of sources: how much of each source, and when in training.

Each source has a weight schedule over training time 0 to 1, linear between knots.  Its integral
is the source's weight in the mix; its shape is the source's demand for tokens over time.  A
document's place in its source's (hashed, repeatable) order is a cumulative token count, and the
time at which cumulative demand reaches that count is its training position.  Sorting by range of
position gives the training order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.textkit import beside, nested

#: No source is read more often than this.
MOST_REPEATS = 3
#: About so many rows of a source share a cell, and so many equal rows a task.
CELL_ROWS = 1 << 16
CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """Weights at knot times, one row of weights a class; sources take the classes in turn."""

    times: tuple[float, ...] = (0.0, 1.0)
    weights: tuple[tuple[float, ...], ...] = ((6.0, 4.0), (2.0, 2.0), (0.5, 1.5))

    def segments(self, row: tuple[float, ...]) -> list[tuple[float, float, float, float, float]]:
        """(start time, length, weight at start, slope, integral before) of each segment."""
        out, before = [], 0.0
        for i in range(len(self.times) - 1):
            dt = self.times[i + 1] - self.times[i]
            out.append((self.times[i], dt, row[i], (row[i + 1] - row[i]) / dt, before))
            before += (row[i] + row[i + 1]) / 2 * dt
        return out

    def integral(self, row: tuple[float, ...]) -> float:
        return sum((row[i] + row[i + 1]) / 2 * (self.times[i + 1] - self.times[i]) for i in range(len(row) - 1))

    def by_class(self, cls: Column, values: list[Column]) -> Column:
        return F.element_at(F.array(*values), cls + 1)

    def time_of(self, cls: Column, share: Column) -> Column:
        """The time by which the given share (0 to 1) of a class's demand has been met."""
        out = None
        for c, row in enumerate(self.weights):
            need, found = share * F.lit(self.integral(row)), None
            for t0, _, w0, slope, before in self.segments(row):
                left = F.greatest(need - F.lit(before), F.lit(0.0))
                root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
                here = F.lit(t0) + F.when(left == 0, F.lit(0.0)).otherwise(2.0 * left / root)
                found = here if found is None else F.when(need >= F.lit(before), here).otherwise(found)
            found = F.least(found, F.lit(1.0))
            out = found if out is None else F.when(cls == c, found).otherwise(out)
        return out


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, schedule: Schedule) -> DataFrame:
    """__key, __source_size, __cls, __target of each source, from (__key, z) totals.

    The sources, by code point with null last, take the classes of the schedule in turn and
    share the sum of all sizes by weight.  A target stops at MOST_REPEATS times its source's
    size; the excess is shared again by weight until none is above.  That level is found in one
    pass: with the sources ordered by (cap / weight), the first whose share of what the ones
    before leave is within its cap sets the level for all that follow.

    The windows run over one row a source.
    """
    n = len(schedule.weights)
    by_name, all_rows = Window.orderBy("__key"), Window.partitionBy()
    rows = cells.groupBy("__key").agg(F.sum("z").alias("source_size"))
    rows = rows.withColumn("cls", ((F.row_number().over(by_name) - 1) % n).cast("int"))
    rows = rows.withColumn("w", schedule.by_class(F.col("cls"), [F.lit(schedule.integral(r)) for r in schedule.weights]))
    rows = rows.withColumns({"cap": MOST_REPEATS * F.col("source_size"), "total": F.sum("source_size").over(all_rows)})
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "__key")
    rows = rows.withColumns({
        "spent": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("share", (F.col("total") - F.col("spent")) / F.col("rest"))
    rows = rows.withColumn("level", F.min_by("share", F.when(F.col("share") <= F.col("ratio"), F.col("spent"))).over(all_rows))
    return rows.select("__key", F.col("source_size").alias("__source_size"), F.col("cls").alias("__cls"), F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("__target"))


def _marked(docs: DataFrame, size: Column, tie: Column, *more: Column) -> DataFrame:
    """__key (the source, null last), __u (a document's place in its source's order), __id and __size of docs, and more."""
    key = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(tie, F.lit(""))))
    return docs.select(key.alias("__key"), place.alias("__u"), F.col("doc_id").alias("__id"), size.cast("long").alias("__size"), *more)


def _runs(marked: DataFrame, n_rows: int, schedule: Schedule) -> DataFrame:
    """Rows of equal place and size as one (__n), with __before, the words before them, and what their source takes.

    Places are hashes of id and text, so cells of them stay small whatever ids repeat, or are null;
    equal documents are counted before anything is ordered.  The cells' number follows the rows'.
    """
    digits = min(5, max(2, math.ceil(math.log(max(n_rows, 1) / CELL_ROWS, 16)))) if n_rows > CELL_ROWS else 2
    runs = marked.withColumn("__cell", F.substring("__u", 1, digits)).groupBy("__key", "__cell", "__u", "__size").agg(F.count("*").alias("__n"), F.first("__id").alias("__id"))
    cells = runs.groupBy("__key", "__cell").agg(F.sum(F.col("__size") * F.col("__n")).alias("z"))
    targets = source_targets(cells, schedule)
    ahead = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__cell0", F.coalesce(F.sum("z").over(ahead), F.lit(0))).drop("z").join(targets, "__key")
    inner = Window.partitionBy("__key", "__cell").orderBy("__u", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("__size") * F.col("__n")).over(inner), F.lit(0))
    return runs.withColumn("__in_cell", before).join(cells, ["__key", "__cell"]).withColumn("__before", F.col("__cell0") + F.col("__in_cell")).drop("__cell", "__cell0", "__in_cell")


def _drawn(rows: DataFrame, schedule: Schedule, whole: bool) -> DataFrame:
    """rows of _runs() with __k, the number of a row among its equals, and so __taken, __draws and __first."""
    size_, before = F.col("__size"), F.col("__before") + F.col("__k") * F.col("__size")
    goal = F.round("__target").cast("long")
    rows = rows.withColumns({"__goal": goal, "__at": before, "__passes": F.when(F.col("__source_size") > 0, F.floor(goal / F.col("__source_size"))).otherwise(0).cast("long")})
    rest = F.col("__goal") - F.col("__passes") * F.col("__source_size")
    part = F.when(2 * F.col("__at") + size_ < 2 * rest, size_).otherwise(0) if whole else F.greatest(F.lit(0), F.least(size_, rest - F.col("__at")))
    again = (2 * F.col("__at") + size_ < 2 * rest) if whole else part > 0
    n_draws = (F.col("__passes") + again.cast("int")).cast("int")
    at = lambda i: schedule.time_of(F.col("__cls"), (i * F.col("__source_size") + F.col("__at") + size_ / 2) / F.greatest(F.col("__goal"), F.lit(1)))
    draws = F.array_compact(F.array(*(F.when(n_draws > i, at(F.lit(i))) for i in range(MOST_REPEATS + 1))))
    return rows.withColumns({"__taken": (F.col("__passes") * size_ + part).cast("long"), "__draws": draws, "__first": F.when(n_draws > 0, at(F.lit(0)))})


def plan_mix(docs: DataFrame, size: Column, schedule: Schedule = Schedule(), tie: Column | None = None) -> DataFrame:
    """A row for every row of docs (doc_id, source, ...): __key, __id, __size, __source_size, __target, __taken, __draws and __first.

    A source with a target of q full passes and a rest draws every document q times, then more
    in hashed order until the rest is met; the last one gives only the words still missing.
    __taken counts words with repeats, __draws is the array of training positions of the draws and
    __first the earliest.

    A null source is a source (__key begins with 1, else with 0); documents of size 0 take nothing unless a
    full pass draws them; sources of size 0 have the target 0; equal rows are drawn one after the other; an
    empty table gives an empty result.  ``tie`` tells documents with one doc_id apart, whatever it hashes.  Two-level
    running sums (cells of a source, then documents of a cell) keep a source with most of the rows out
    of a single task.  A very long text counts as one draw.
    """
    runs = _runs(_marked(docs, size, F.lit("") if tie is None else tie), docs.count(), schedule)
    one = lambda first, n: F.explode(F.sequence(F.lit(0).cast("long") + first, first + n - 1))
    few = runs.where(F.col("__n") <= CHUNK).withColumn("__k", one(F.lit(0), F.col("__n")))
    # equal rows beyond a chunk are dealt by chunks before they become rows
    chunks = runs.where(F.col("__n") > CHUNK).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK))))
    many = chunks.repartition("__u", "__chunk").withColumn("__k", one(F.col("__chunk"), F.least(F.lit(CHUNK), F.col("__n") - F.col("__chunk")))).drop("__chunk")
    return _drawn(few.unionByName(many), schedule, whole=False)


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position_ppb of every row, sorted by range of position.

    Size is the number of words (null text: 0); see plan_mix() for ties, nulls and repeated rows.
    Other columns are ignored; an empty table gives an empty result.  position_ppb is the training time of the first
    draw in billionths; null, and last, for a document that the mix leaves out.
    """
    plan = plan_mix(docs.select("doc_id", "source", word_count().alias("size"), F.md5("text").alias("tie")), F.col("size"), tie=F.col("tie"))
    out = plan.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), F.col("__taken").alias("taken"), F.floor(F.col("__first") * 1e9).cast("long").alias("position_ppb"))
    return out.orderBy(F.col("position_ppb").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, schedule: Schedule = Schedule()) -> DataFrame:
    """The rows of docs in training order, whole documents, one row a draw.

    As plan_mix(), but for the rest of a target: there a document is drawn if its middle lies within
    it.  Null sources and null texts are carried; a document without words comes only with a full pass of its
    source; rows of equal doc_id and text are drawn one after the other, in any order; an empty table gives an empty
    result.  Only places and sizes are ordered; whole rows are joined to them once, and sorted by range.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = _marked(docs, word_count(), F.md5("text"), nested(docs), F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("__part"))
    plan = scratch.keep("plan", _runs(rows.drop("row", "__part"), docs.count(), schedule).drop("__id"))
    joined = rows.drop("__id").join(plan, ["__key", "__u", "__size"])
    key = ["__key", "__u", "__size"]
    if plan.where("__n > 1").isEmpty():
        placed = _drawn(joined.withColumn("__k", F.lit(0).cast("long")), schedule, whole=True)
    else:
        repeated = scratch.keep("repeated", joined.where("__n > 1"))
        parts = repeated.groupBy(*key, "__part").agg(F.count("*").alias("__rows"))
        ahead = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0))).drop("__rows")
        inside = Window.partitionBy(*key, "__part").orderBy(F.lit(0))
        numbered = repeated.withColumn("__in", F.row_number().over(inside) - 1).join(parts, [*key, "__part"]).withColumn("__k", F.col("__ahead") + F.col("__in")).drop("__ahead", "__in")
        placed = _drawn(joined.where("__n = 1").withColumn("__k", F.lit(0).cast("long")).unionByName(numbered), schedule, whole=True)
    return beside(placed.select("row", F.explode("__draws").alias("at"), "__u").orderBy("at", "__u"))


#: DuckDB SQL of mix_digest() over documents, for the default schedule.
MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS u
  FROM documents),
named AS (
  SELECT k, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 AS cls
  FROM docs GROUP BY k),
weighed AS (
  SELECT *, (CASE cls WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w,
         sum(source_size) OVER ()::BIGINT AS total FROM named),
ordered AS (
  SELECT *, (3 * source_size)::DOUBLE / w AS ratio,
         coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
         sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
shared AS (SELECT *, (total - spent)::DOUBLE / rest AS share FROM ordered),
level AS (SELECT coalesce(min_by(share, spent), 0) AS level FROM shared WHERE share <= ratio),
targets AS (
  SELECT k, source_size, cls, least((3 * source_size)::DOUBLE, level * w) AS target,
         round(least((3 * source_size)::DOUBLE, level * w))::BIGINT AS goal
  FROM shared, level),
placed AS (
  SELECT d.doc_id, d.size, t.*,
         (sum(d.size) OVER (PARTITION BY d.k ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before
  FROM docs d JOIN targets t ON d.k = t.k),
passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM placed),
parted AS (
  SELECT *, greatest(0, least(size, goal - passes * source_size - before)) AS part,
         (before + size / 2.0::DOUBLE) / greatest(goal, 1) AS done FROM passed),
timed AS (
  SELECT *, CASE cls WHEN 0 THEN done * 5.0::DOUBLE WHEN 1 THEN done * 2.0::DOUBLE ELSE done * 1.0::DOUBLE END AS need,
         CASE cls WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE cls WHEN 0 THEN -4.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS slope2 FROM parted)
SELECT doc_id, size, source_size, round(target, 6) AS target, (passes * size + part)::BIGINT AS taken,
       CASE WHEN passes > 0 OR part > 0 THEN floor(least(1.0::DOUBLE, CASE WHEN need = 0 THEN 0.0::DOUBLE
         ELSE 2.0::DOUBLE * need / (w0 + sqrt(greatest(w0 * w0 + slope2 * need, 0.0::DOUBLE))) END) * 1e9::DOUBLE)::BIGINT END AS position_ppb
FROM timed
"""
