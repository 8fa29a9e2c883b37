"""Question and answer threads: selection, canonical text, identity, duplicates and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(questions: DataFrame, answers: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Each question with the array ``answers`` of structs of the fields, in order; empty without any."""
    packed = answers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("answers"))
    return questions.join(packed, key, "left").withColumn("answers", F.coalesce("answers", F.array()))


def select_answers(answers: DataFrame, key: str, accepted: Column, order: list[Column], extra: int) -> DataFrame:
    """The accepted answer of each question and ``extra`` more by order, ranked from 1.

    Without an accepted answer one more of the others takes its place.
    """
    rank = Window.partitionBy(key).orderBy(F.when(accepted, 0).otherwise(1), *order)
    return answers.withColumn("rank", F.row_number().over(rank).cast("bigint")).where(F.col("rank") <= 1 + extra)


def select_corpus_answers(answers: DataFrame, key: str, answer: str, declared: str, flagged: str, usable: Column, order: list[Column], extra: int) -> DataFrame:
    """answers with rank, accepted and missing_accepted (of the question): the accepted one and ``extra`` others.

    The accepted answer is the one that the question declares; without a declaration it is the
    flagged one with the smallest id.  A declared answer that is not there, or is blank, is
    missing: another takes its place in number but is not accepted.  Only usable answers count.
    """
    mine = Window.partitionBy(key)
    first_flag = F.min(F.when(F.col(flagged), F.col(answer))).over(mine)
    accepted = F.coalesce(F.col(answer) == F.coalesce(F.col(declared), first_flag), F.lit(False))
    rows = answers.where(usable).withColumn("accepted", accepted)
    rows = rows.withColumn("missing_accepted", F.col(declared).isNotNull() & ~F.bool_or("accepted").over(mine))
    rank = mine.orderBy(F.desc("accepted"), *order)
    return rows.withColumn("rank", F.row_number().over(rank).cast("bigint")).where(F.col("rank") <= 1 + extra)


def reconcile_answers(stored: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """key, source_missing, value: stored answers stay and are marked missing where the source no longer has them."""
    both = stored.select(key, F.col(value).alias("old")).join(incoming.select(key, F.col(value).alias("new"), F.lit(True).alias("here")), key, "full_outer")
    return both.select(key, F.col("here").isNull().alias("source_missing"), F.coalesce("new", "old").alias(value))


def effective_tags(links: DataFrame, doc: str, tag: str, managed: str) -> DataFrame:
    """doc and tags (sorted, distinct): managed tags where there are any, else those of the source."""
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(tag))))
    both = links.groupBy(doc).agg(of(F.col(managed)).alias("own"), of(~F.col(managed)).alias("other"))
    return both.select(doc, F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("other")).alias("tags"))


def replace_tags(links: DataFrame, fresh: DataFrame, doc: str, managed: str) -> DataFrame:
    """links after documents arrive anew: their source links are replaced, managed links stay."""
    kept = links.where(F.col(managed)).unionByName(links.where(~F.col(managed)).join(fresh.select(doc).distinct(), doc, "left_anti").select(links.columns))
    return kept.unionByName(fresh).distinct()


def exact_duplicates(docs: DataFrame, content: Column, created: Column, key: str) -> DataFrame:
    """docs with duplicate_of: the earliest document of equal content, null for that one.

    The earliest of each content is found by a partial aggregate and joined back, so that one
    content with very many copies is never gathered in one task.
    """
    hashed = docs.withColumns({"content_hash": F.sha2(content, 256), "created": created})
    first = hashed.groupBy("content_hash").agg(F.min(F.struct("created", key)).alias("first"))
    out = hashed.join(first, "content_hash")
    return out.withColumn("duplicate_of", F.when(F.col(f"first.{key}") != F.col(key), F.col(f"first.{key}"))).drop("first")


def classify_upserts(current: DataFrame, incoming: DataFrame, key: str, hash_: str, version: str) -> DataFrame:
    """key, outcome and version of an upsert by identity: INSERTED, UPDATED or UNCHANGED, or ABSENT."""
    joined = current.select(key, F.col(hash_).alias("old"), F.col(version).alias("v")).join(incoming.select(key, F.col(hash_).alias("new")), key, "full_outer")
    outcome = F.when(F.col("old").isNull(), "INSERTED").when(F.col("new").isNull(), "ABSENT").when(F.col("old") != F.col("new"), "UPDATED").otherwise("UNCHANGED")
    return joined.select(key, outcome.alias("outcome"), F.when(F.col("old").isNull(), 1).when(F.col("old") != F.col("new"), F.col("v") + 1).otherwise(F.col("v")).cast("bigint").alias("version"))


def merge_last_write(current: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of current replaced by the last change of the same key, and new keys added."""
    last = Window.partitionBy(*key).orderBy(*order)
    kept = changes.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")
    return current.join(kept, key, "left_anti").unionByName(kept)


def newest_revisions(revisions: DataFrame, key: str, version: str, keep: int) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    return revisions.withColumn("age", F.row_number().over(newest).cast("bigint")).where(F.col("age") <= keep)


def number_rows(rows: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """rows with ``place``, from 0 in the order of a whole-number key without ties.

    Ranges of ``width`` keys are counted, the counts summed in order, and rows placed within
    their range, so that no task sees more than one range of rows.
    """
    cut = rows.withColumn("__range", F.floor(F.col(key) / width))
    counts = cut.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return cut.withColumn("__in", inside).join(starts, "__range").withColumn("place", F.col("__start") + F.col("__in")).drop("__range", "__start", "__in")
