"""Context for cited answers: packing, duplicates, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import escape_citations


def pack_context(passages: Column, budget: int, least: int, most: int) -> Column:
    """The passages (struct of id, n tokens; in rank order) that fit a token budget.

    One that does not fit is cut to what is left, if that is at least ``least`` tokens, and
    otherwise skipped without stopping; at most ``most`` are taken.  Returns structs (id, n, cut).
    """
    none = F.array().cast("array<struct<id:bigint,n:bigint,cut:boolean>>")

    def step(acc: Column, p: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        fits = p["n"] <= left
        take = (F.size(acc["got"]) < most) & (fits | (left >= least))
        n = F.when(fits, p["n"]).otherwise(left).cast("bigint")
        one = F.struct(p["id"].alias("id"), n.alias("n"), (~fits).alias("cut"))
        return F.struct(F.when(take, F.concat(acc["got"], F.array(one))).otherwise(acc["got"]).alias("got"), F.when(take, acc["used"] + n).otherwise(acc["used"]).alias("used"))

    return F.aggregate(passages, F.struct(none.alias("got"), F.lit(0).cast("bigint").alias("used")), step, lambda acc: acc["got"])


def drop_contained(passages: Column, least: int) -> Column:
    """Passages (struct of id, text; in rank order) without those that an earlier one repeats.

    Texts are compared folded; one of at least ``least`` characters inside another is a repeat
    of it, whichever is longer.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))
    none = F.array().cast("array<struct<id:bigint,text:string>>")

    def same(a: Column, b: Column) -> Column:
        inside = lambda x, y: (F.length(x) >= least) & F.contains(y, x)
        return (a == b) | inside(a, b) | inside(b, a)

    def step(acc: Column, p: Column) -> Column:
        one = F.struct(p["id"].alias("id"), fold(p["text"]).alias("text"))
        return F.when(F.exists(acc, lambda q: same(q["text"], one["text"])), acc).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(passages, none, step)


def context_text(passages: Column, budget: int = 2500, sources: int = 6, least: int = 40) -> Column:
    """The context of an answer from passages (struct of id, title, text; in the order of their groups).

    Each passage is one document's joined text, without citations of its own, in a numbered block
    whose whole length counts (4 characters a token).  One that does not fit is cut, at the last
    line end of what is left if that is past its half, and left out if under ``least`` tokens are
    left; at most ``sources`` are taken.  A struct of text, tokens and sources (citation, id, cut).
    """
    none = F.array().cast("array<struct<citation:int,id:bigint,cut:boolean>>")
    tokens = lambda c: F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4))
    block = lambda i, p, text: F.format_string('<source id="%d">\nTitle: %s\n\n%s\n</source>', i, p["title"], text)

    def cut(text: Column, size: Column) -> Column:
        start = F.left(text, size.cast("int"))
        line = size - F.instr(F.reverse(start), "\n")
        return F.rtrim(F.when(F.contains(start, F.lit("\n")) & (2 * line > size), F.left(start, line.cast("int"))).otherwise(start))

    def step(acc: Column, p: Column) -> Column:
        safe, number, left = escape_citations(p["text"]), F.size(acc["got"]) + 1, F.lit(budget) - acc["used"]
        fits = tokens(block(number, p, safe)) <= left
        shown = F.when(fits, block(number, p, safe)).otherwise(block(number, p, cut(safe, 4 * left)))
        take = (F.size(acc["got"]) < sources) & (fits | (left >= least))
        one = F.struct(number.alias("citation"), p["id"].alias("id"), (~fits).alias("cut"))
        return F.when(~take, acc).otherwise(F.struct(F.array_append(acc["blocks"], shown).alias("blocks"), F.array_append(acc["got"], one).alias("got"), (acc["used"] + tokens(shown)).alias("used")))

    start = F.struct(F.array().cast("array<string>").alias("blocks"), none.alias("got"), F.lit(0).cast("bigint").alias("used"))
    return F.aggregate(passages, start, step, lambda acc: F.struct(F.array_join(acc["blocks"], "\n\n").alias("text"), acc["used"].alias("tokens"), acc["got"].alias("sources")))


def answer_measures(expected: Column, returned: Column, points: Column, answer: Column, valid: Column, expected_refusal: Column, refused: Column) -> dict[str, Column]:
    """source_recall, citation_validity, key_point_coverage and refusal_right of one answer; nothing expected is met by nothing returned."""
    low = F.lower(answer)
    found = F.size(F.filter(points, lambda x: F.contains(low, F.lower(x))))
    wanted = F.array_distinct(expected)
    return {
        "source_recall": F.when(F.size(wanted) == 0, (F.size(returned) == 0).cast("double")).otherwise(F.round(F.size(F.array_intersect(wanted, returned)) / F.size(wanted), 6)),
        "citation_validity": F.coalesce(valid, F.lit(False)).cast("double"),
        "key_point_coverage": F.when(F.size(points) == 0, 1.0).otherwise(F.round(found / F.size(points), 6)),
        "refusal_right": (F.coalesce(expected_refusal, F.lit(False)) == F.coalesce(refused, F.lit(False))).cast("double"),
    }


def context_gate(sources: Column, tokens: Column, top: Column, least_sources: int = 1, least_tokens: int = 40, least_score: float = 0.25) -> Column:
    """Why a context is not enough for an answer: NO_SOURCES, FEW_TOKENS or WEAK; else OK."""
    return F.when(sources < least_sources, "NO_SOURCES").when(tokens < least_tokens, "FEW_TOKENS").when(F.coalesce(top, F.lit(0.0)) < least_score, "WEAK").otherwise("OK")


def ask_once(runs: DataFrame, asked: DataFrame, key: str, body: str, order: list[Column]) -> DataFrame:
    """asked (key, body) with outcome: REPLAY of a run of the same body, CONFLICT with another body, NEW, or REPEAT of a new one."""
    known = runs.groupBy(key).agg(F.first(body).alias("__known"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = asked.join(known, key, "left").withColumn("__place", place)
    first = F.first(body).over(Window.partitionBy(key).orderBy("__place"))
    rows = rows.withColumn("__of", F.coalesce("__known", first))
    same = F.col("__of") == F.col(body)
    outcome = F.when(~same, "CONFLICT").when(F.col("__known").isNotNull(), "REPLAY").when(F.col("__place") == 1, "NEW").otherwise("REPEAT")
    return rows.withColumn("outcome", outcome).drop("__known", "__place", "__of")


def confidence(top: Column, mean: Column, sources: Column, cited: Column, enough: Column) -> tuple[Column, Column]:
    """A score from the best and mean relevance, the sources and the share cited, and its level."""
    score = 0.45 * top + 0.25 * mean + 0.15 * F.least(F.lit(1.0), sources / 3) + 0.15 * F.least(F.lit(1.0), cited / F.greatest(sources, F.lit(1)))
    score = F.when(enough, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).otherwise(0.1)
    return score, F.when(score >= 0.72, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")
