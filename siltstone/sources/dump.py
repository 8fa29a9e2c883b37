"""Readers of question and answer dumps: XML rows, paged JSON answers, JSONL evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import tag_list

ROW = "Id string, PostTypeId string, ParentId string, CreationDate string, LastActivityDate string, LastEditDate string, Score string, ViewCount string, Body string, OwnerUserId string, OwnerDisplayName string, Title string, Tags string, AnswerCount string, AcceptedAnswerId string, ContentLicense string"
PAGE = "items array<struct<question_id:bigint,title:string,body:string,tags:array<string>,link:string,creation_date:bigint,last_activity_date:bigint,score:bigint,answer_count:bigint,accepted_answer_id:bigint,is_answered:boolean>>, has_more boolean, quota_remaining bigint, backoff bigint, error_id bigint, error_message string"
QUERY = "id string, query string, relevantExternalIds array<string>, tags array<string>, split string, notes string"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The attributes of every ``<row .../>``; a split of the file is enough for each task."""
    return spark.read.format("xml").option("rowTag", "row").option("attributePrefix", "").schema(ROW).load(path)


def whole(c: str) -> Column:
    """A number from text: blank is null, anything else must be one."""
    return F.nullif(F.trim(c), F.lit("")).cast("bigint")


def epoch(c: str) -> Column:
    """Seconds since 1970 of an ISO time in UTC."""
    return F.unix_timestamp(F.to_timestamp(F.nullif(F.trim(c), F.lit(""))))


def owner() -> Column:
    known = F.col("OwnerUserId").isNotNull() | F.col("OwnerDisplayName").isNotNull()
    return F.when(known, F.struct(whole("OwnerUserId").alias("user_id"), F.col("OwnerDisplayName").alias("display_name")))


def questions(rows: DataFrame) -> DataFrame:
    created, accepted, count = epoch("CreationDate"), whole("AcceptedAnswerId"), F.coalesce(whole("AnswerCount"), F.lit(0))
    return rows.where("PostTypeId = '1'").select(
        whole("Id").alias("question_id"), F.col("Title").alias("title"), F.col("Body").alias("body"), tag_list(F.col("Tags")).alias("tags"), created.alias("creation_date"),
        F.coalesce(epoch("LastActivityDate"), created).alias("last_activity_date"), F.coalesce(whole("Score"), F.lit(0)).alias("score"), count.alias("answer_count"),
        accepted.alias("accepted_answer_id"), (accepted.isNotNull() | (count > 0)).alias("is_answered"), owner().alias("owner"), F.col("ContentLicense").alias("content_license"),
    )


def answers(rows: DataFrame) -> DataFrame:
    created = epoch("CreationDate")
    return rows.where("PostTypeId = '2'").select(
        whole("Id").alias("answer_id"), whole("ParentId").alias("question_id"), F.col("Body").alias("body"), created.alias("creation_date"),
        F.coalesce(epoch("LastActivityDate"), created).alias("last_activity_date"), F.coalesce(whole("Score"), F.lit(0)).alias("score"), owner().alias("owner"),
    )


def threads(rows: DataFrame, tag: str, known: DataFrame, first: int, answerless: bool = False) -> DataFrame:
    """The first questions by id with the tag that are not known (question_id), each with its answers."""
    asked = questions(rows).where(F.exists("tags", lambda x: F.lower(x) == tag.lower()))
    if answerless:
        asked = asked.where("answer_count = 0")
    return _with_answers(asked.join(known, "question_id", "left_anti").orderBy("question_id").limit(first), rows)


def threads_by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The questions with the given ids (question_id), each once with its answers; ids of no question give nothing."""
    wanted = ids.select("question_id").distinct()
    return _with_answers(questions(rows).join(wanted, "question_id", "left_semi"), rows)


def _with_answers(asked: DataFrame, rows: DataFrame) -> DataFrame:
    replies = answers(rows).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("answer_id", "body", "score", "creation_date", "owner"))).alias("answers"))
    out = asked.join(replies, "question_id", "left")
    return out.withColumn("answers", F.transform(F.coalesce("answers", F.array()), lambda a: a.withField("is_accepted", F.coalesce(a["answer_id"] == F.col("accepted_answer_id"), F.lit(False)))))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row an item of saved API pages; unknown fields are ignored and failed pages give nothing."""
    pages = spark.read.schema(PAGE).json(path)
    return pages.where("error_id IS NULL").select(F.explode("items").alias("i")).select("i.*")


def read_queries(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(QUERY).json(path)
    return rows if split is None else rows.where(F.col("split") == split)


ANSWERED = "id string, query string, expectedExternalIds array<string>, requiredPoints array<string>, expectedInsufficient boolean, notes string"


def read_answered(spark: SparkSession, path: str) -> DataFrame:
    """The answer evaluation set: what an answer should cite and say, and whether it should refuse.

    Missing lists are empty and a missing refusal is none; a line without an id or a query, or that is no
    JSON, is an error of the set and raises when it is read.
    """
    rows = spark.read.schema(ANSWERED + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    empty = F.array().cast("array<string>")
    wrong = F.col("broken").isNotNull() | (F.trim(F.coalesce("id", F.lit(""))) == "") | (F.trim(F.coalesce("query", F.lit(""))) == "")
    key = F.when(wrong, F.raise_error(F.concat(F.lit("a line of the evaluation set is broken: "), F.coalesce("broken", "id", "query", F.lit("?"))))).otherwise(F.col("id"))
    return rows.select(
        key.alias("id"), "query", F.coalesce("expectedExternalIds", empty).alias("expected"), F.coalesce("requiredPoints", empty).alias("points"),
        F.coalesce("expectedInsufficient", F.lit(False)).alias("refuse"), "notes",
    )
