"""What enters the corpus and the index: gates, canonical documents, eligibility, payloads, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.variants import quoted

#: The section labels of a canonical document (fixed values).
QUESTION, ACCEPTED, FURTHER = "Вопрос", "Принятый ответ", "Дополнительный ответ"
ALLOWED_STATUSES = ("ACTIVE", "OUTDATED")


@dataclass(frozen=True)
class Limits:
    """Most answers of a question, least characters of a question and of an answer, most of any text."""

    answers: int = 500
    question: int = 20
    answer: int = 1
    text: int = 200_000


def gate(threads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """threads with ``reject`` (a code, or null) and ``warnings`` (structs of code and answer_id, by id and code).

    A thread has question_id, title, text, url, accepted_id and answers (structs of answer_id, question_id
    and text, all cleaned).  Rejected: too many answers, an empty title, a text that is too long or too short, an
    address that is none, in this order.  Warned of, but kept: answers of another question, too long or
    too short ones, and an accepted answer that is not among those that are left.  Nulls are empty.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    n = F.length(blank(F.col("text")))
    reject = (
        F.when(F.size("answers") > limits.answers, "TOO_MANY_ANSWERS").when(blank(F.col("title")) == "", "EMPTY_TITLE").when(n > limits.text, "CLEANED_CONTENT_TOO_LARGE")
        .when(n < limits.question, "QUESTION_TOO_SHORT").when(~F.coalesce(F.col("url").rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False)), "INVALID_SOURCE_URL")
    )
    size = lambda a: F.length(blank(a["text"]))
    code = lambda a: F.when(a["question_id"] != F.col("question_id"), "ANSWER_QUESTION_MISMATCH").when(size(a) > limits.text, "CLEANED_CONTENT_TOO_LARGE").when(size(a) < limits.answer, "ANSWER_TOO_SHORT")
    found = F.filter(F.transform("answers", lambda a: F.struct(a["answer_id"].cast("string").alias("answer_id"), code(a).alias("code"))), lambda w: w["code"].isNotNull())
    usable = F.exists("answers", lambda a: (a["answer_id"] == F.col("accepted_id")) & (a["question_id"] == F.col("question_id")) & size(a).between(limits.answer, limits.text))
    missing = F.when(F.col("accepted_id").isNotNull() & ~F.coalesce(usable, F.lit(False)), F.array(F.struct(F.col("accepted_id").cast("string").alias("answer_id"), F.lit("ACCEPTED_ANSWER_MISSING").alias("code"))))
    empty = F.array().cast("array<struct<answer_id:string,code:string>>")
    every = F.array_sort(F.concat(found, F.coalesce(missing, empty)))
    return threads.withColumns({"reject": reject, "warnings": F.when(reject.isNull(), every).otherwise(empty)})


def canonical(threads: DataFrame) -> DataFrame:
    """threads (title, tags, text, answers in order, of structs with accepted and text) with sections, canonical text and content_hash.

    The text is the title, the tags and each section under its label, parts apart by an empty line and empty
    ones left out.  The hash is that of a JSON value with sorted keys and no blanks, of title, tags and
    the sections' types and texts.
    """
    labelled = F.transform(
        "answers",
        lambda a, i: F.struct(
            F.when(a["accepted"], "ACCEPTED_ANSWER").otherwise("ANSWER").alias("type"),
            F.when(a["accepted"], ACCEPTED).otherwise(F.concat(F.lit(FURTHER + " "), (F.size(F.filter(F.slice("answers", 1, i + 1), lambda b: ~b["accepted"]))).cast("string"))).alias("label"), a["text"].alias("text"),
        ),
    )
    question = F.struct(F.lit("QUESTION").alias("type"), F.lit(QUESTION).alias("label"), F.col("text"))
    out = threads.withColumn("sections", F.concat(F.array(question), labelled))
    parts = F.concat(
        F.array(F.concat(F.lit("# "), "title"), F.concat(F.lit("Теги: "), F.array_join("tags", ", "))),
        F.flatten(F.transform("sections", lambda s: F.array(F.concat(F.lit("## "), s["label"]), s["text"]))),
    )
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    section = lambda s: F.concat(F.lit('{"text":'), quoted(s["text"]), F.lit(',"type":'), quoted(s["type"]), F.lit("}"))
    value = F.concat(
        F.lit('{"sections":['), F.array_join(F.transform("sections", section), ","), F.lit('],"tags":['), F.array_join(F.transform("tags", quoted), ","), F.lit('],"title":'), quoted(F.col("title")), F.lit("}"),
    )
    return out.withColumns({"canonical": F.regexp_replace(joined, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), "content_hash": F.sha2(value, 256)})


def outcome(old_hash: Column, new_hash: Column, duplicate_of: Column) -> Column:
    """DUPLICATE wherever the content is another document's, else INSERTED, UPDATED or UNCHANGED."""
    return F.when(duplicate_of.isNotNull(), "DUPLICATE").when(old_hash.isNull(), "INSERTED").when(old_hash != new_hash, "UPDATED").otherwise("UNCHANGED")


def document_is_eligible(possible_duplicates: bool = False) -> Column:
    """Over status, processing_status, deduplication_status and processing_error of a document."""
    kinds = ("UNIQUE", "POSSIBLE_DUPLICATE") if possible_duplicates else ("UNIQUE",)
    fine = (F.col("processing_status") == "CHUNKED") & F.col("status").isin(*ALLOWED_STATUSES) & F.col("deduplication_status").isin(*kinds)
    return F.coalesce(fine, F.lit(False)) & (F.coalesce("processing_error", F.lit("")) == "")


def payload(documents: DataFrame, chunks: DataFrame, indexed_at: str, schema_version: str, possible_duplicates: bool = False) -> DataFrame:
    """The 24 fields of each eligible chunk's point, and its contextual text.

    ``documents`` has document_id, version, content_hash, source_id, source_type, source_url, title, tags,
    published_at, score, answers_count, accepted_id, has_code and the columns of document_is_eligible();
    ``chunks`` document_id, chunk_id, ordinal, document_version, chunk_hash, text, contextual_text, chunk_code,
    section_type and language.  A chunk counts that is of its document's version and not blank.
    """
    rows = chunks.join(documents.where(document_is_eligible(possible_duplicates)), "document_id")
    rows = rows.where((F.col("document_version") == F.col("version")) & (F.trim("text") != "") & (F.trim("contextual_text") != ""))
    return rows.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), "document_version", F.col("ordinal").alias("chunk_ordinal"),
        F.col("chunk_hash").alias("chunk_content_hash"), F.col("content_hash").alias("document_content_hash"), F.col("source_id").cast("string").alias("source_id"), "source_type", "source_url", "title",
        F.array_sort(F.array_distinct("tags")).alias("tags"), "published_at", F.col("score").alias("question_score"), "answers_count", F.col("accepted_id").isNotNull().alias("accepted_answer"),
        (F.col("chunk_code") | F.col("has_code")).alias("has_code"), "section_type", F.coalesce("language", F.lit("")).alias("language"), F.col("status").alias("document_status"), "processing_status",
        "deduplication_status", F.lit(indexed_at).alias("indexed_at"), F.lit(schema_version).alias("index_schema_version"), F.substring("text", 1, 280).alias("text_preview"), "contextual_text",
    )


def index_checks(points: DataFrame, entries: DataFrame, documents: DataFrame, chunks: DataFrame, manifest_points: int, pointer_right: bool, schema_right: bool, sample: int = 100) -> DataFrame:
    """code, actual, expected and status of the nine checks of an active index.

    ``points`` are payloads, ``entries`` (document_id, status) the index's own records, ``documents`` and ``chunks``
    what payload() takes.  The sample is the ``sample`` points with the smallest chunk_id; one is stale if its document is
    gone, no longer eligible, or of another version.
    """
    here = documents.select(F.col("document_id").cast("string").alias("document_id"), "version", document_is_eligible().alias("fine"))
    rows = chunks.where(F.trim("text") != "").select(F.col("document_id").cast("string").alias("document_id"), "document_version").join(here.where("fine"), "document_id").where("document_version = version")
    one = lambda df, c, name: df.agg(c.cast("bigint").alias(name))
    shown = points.orderBy("chunk_id").limit(sample).select("document_id", F.col("document_version").alias("shown")).join(here, "document_id", "left")
    counts = (
        one(points, F.count("*"), "points")
        .crossJoin(one(points, F.count_if(F.col("document_status") == "HIDDEN"), "hidden")).crossJoin(one(points, F.count_if(F.col("processing_status") == "FAILED"), "failed"))
        .crossJoin(one(points, F.count_if(F.col("deduplication_status") == "EXACT_DUPLICATE"), "duplicate")).crossJoin(one(rows, F.count("*"), "eligible"))
        .crossJoin(one(entries, F.count_if(F.col("status") == "INDEXED"), "entries")).crossJoin(one(shown, F.count_if(~F.coalesce(F.col("fine") & (F.col("shown") == F.col("version")), F.lit(False))), "stale"))
    )  # fmt: skip  one row each
    checks = (
        ("index_pointer", F.lit(int(pointer_right)), F.lit(1)), ("collection_schema", F.lit(int(schema_right)), F.lit(1)), ("point_count", F.col("points"), F.col("eligible")),
        ("entry_count", F.col("entries"), F.col("points")), ("manifest_point_count", F.lit(manifest_points), F.col("points")), ("hidden_points_absent", F.col("hidden"), F.lit(0)),
        ("failed_points_absent", F.col("failed"), F.lit(0)), ("duplicate_points_absent", F.col("duplicate"), F.lit(0)), ("sample_payloads_current", F.col("stale"), F.lit(0)),
    )
    listed = F.array(*(F.struct(F.lit(code).alias("code"), a.cast("bigint").alias("actual"), e.cast("bigint").alias("expected")) for code, a, e in checks))
    return counts.select(F.explode(listed).alias("c")).select("c.*", F.when(F.col("c.actual") == F.col("c.expected"), "PASS").otherwise("FAIL").alias("status"))


def overall() -> Column:
    """An aggregate over checks (status, required): FAIL if a required one failed or was not run, else WARNING if any warned or was not run, else PASS."""
    bad = F.col("required") & F.col("status").isin("FAIL", "NOT_RUN")
    return F.when(F.count_if(bad) > 0, "FAIL").when(F.count_if(F.col("status").isin("WARNING", "NOT_RUN")) > 0, "WARNING").otherwise("PASS")
