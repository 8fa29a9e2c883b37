"""Quality rules as weak supervision: rules vote or abstain, and what their votes say together decides.

Each rule looks at one side of a text and votes bad, good or not at all.  Expectation-maximisation
over the counts of vote patterns estimates how common good texts are, and for each rule how often it
votes bad on bad texts and good on good ones; a text is kept if it is probably good.  So one
fault's votes count for much where they come with others, and for little where they come alone.
Everything about rows is a DataFrame expression; the patterns, of which there are 3 to the power
of the rules at most however many rows there are, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Whitespace of words, in a pattern's class.
_GAP = r"\x20\x09-\x0D"

ROUNDS = 200
#: What is supposed of a rule before votes are seen: how often it votes bad on bad texts and good on
#: good ones, and how many votes that supposition weighs; and the same of good texts among all.
FIRST_BAD, FIRST_GOOD, FIRST_SHARE, STRENGTH = 0.7, 0.97, 0.9, 20
LEAST_SHARE, MOST_SHARE, LEAST_RATE = 0.5, 0.99, 1e-3


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated_words(words: Column) -> Column:
    """The words in windows of GRAM words that the text has at least twice.

    Window hashes are sorted with their places; equal neighbours are repeats, and each repeat's
    place adds the words that the place before did not cover.
    """
    starts = F.sequence(F.lit(1), F.size(words) - GRAM + 1)
    hashes = F.when(F.size(words) >= GRAM, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, GRAM)))).otherwise(F.array().cast("array<bigint>"))

    def covered(sorted_: Column) -> Column:
        h = lambda j: F.get(sorted_, j).getField("h")
        places = F.transform(sorted_, lambda e, j: F.when((e["h"] == h(j - 1)) | (e["h"] == h(j + 1)), e["i"]))
        first = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(F.sort_array(F.array_compact(places)), first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(GRAM), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(hs: Column) -> Column:
        pairs = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(pairs), covered))

    return let(hashes, count)


def measures(text: Column) -> Column:
    """A struct of counts over the whole text (null: no words)."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{_GAP}]"))
        many = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            (F.length(text) - many(f"[{_GAP}]")).cast("bigint").alias("word_chars"),
            many(f"[{SYMBOLS}]").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("bigint").alias("n_runs"),
            many(rf"(?<![^{_GAP}])\p{{L}}+[.,;:!?]?(?![^{_GAP}])").alias("n_plain"),
            F.length(F.regexp_replace(text, rf"[\p{{L}}{_GAP}]+", "")).cast("bigint").alias("n_odd"),
            many("[A-Z]").alias("n_capitals"),
            many("!").alias("n_shouts"),
            many("[.?!]").alias("n_marks"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(F.array_remove(F.split(text, SPACE), ""), of)


def votes() -> dict[str, Column]:
    """1 (good), 0 (bad) or null (no opinion) of each rule, over the columns of measures().

    A rule votes bad beyond a limit that ordinary texts rarely pass, good well inside it, and not
    at all between.
    """
    c, n, chars = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    long = n >= 2000  # the longer a text, the fewer of its words are new
    vote = lambda bad, good: F.when(bad, 0).when(good, 1)
    return {
        "symbols": vote(10 * c("n_symbols") > n, 100 * c("n_symbols") <= n),
        "plain": vote(10 * c("n_plain") < 7 * n, 10 * c("n_plain") >= 9 * n),
        "letters": vote(10 * c("n_odd") > chars, 20 * c("n_odd") <= chars),
        "lines": vote((4 * c("n_dup_lines") > c("n_lines")) & (c("n_dup_lines") > 2), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        "repeats": vote(100 * c("n_repeat_words") > 15 * n, (n >= 50) & (c("n_repeat_words") == 0)),
        "runs": vote(5 * c("n_runs") > n, 100 * c("n_runs") <= 3 * n),
        "variety": vote((10 * c("n_distinct") < 4 * n) & ~long, long | (2 * c("n_distinct") >= n)),
        "lengths": vote((chars > 12 * n) | (chars < 3 * n), (chars >= 4 * n) & (chars <= 8 * n)),
        "capitals": vote(4 * c("n_capitals") > chars, (1000 * c("n_capitals") >= 3 * chars) & (100 * c("n_capitals") <= 8 * chars)),
        "sentences": vote((c("n_marks") == 0) & (n >= 60), (100 * c("n_marks") >= 3 * n) & (100 * c("n_marks") <= 20 * n)),
        "shouts": vote(100 * c("n_shouts") > 17 * n, F.lit(False)),
    }


@dataclass
class Accuracies:
    """How common good texts are, and of each rule how often it votes bad on bad texts and good on good ones, when it votes."""

    share: float
    bad: dict[str, float]
    good: dict[str, float]

    def weights(self, rule: str) -> tuple[float, float]:
        """What a bad and a good vote add to the log odds of a good text."""
        return math.log((1 - self.good[rule]) / self.bad[rule]), math.log(self.good[rule] / (1 - self.bad[rule]))

    @property
    def start(self) -> float:
        return math.log(self.share / (1 - self.share))


def posterior(rules: list[str], accuracy: Accuracies) -> Column:
    """The probability that a text with the votes in the columns v_<rule> is good."""
    score = F.lit(accuracy.start)
    for r in rules:
        bad, good = accuracy.weights(r)
        score = score + F.when(F.col(f"v_{r}") == 1, good).when(F.col(f"v_{r}") == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def estimate(patterns: DataFrame, rules: list[str]) -> Accuracies:
    """Accuracies by expectation-maximisation over counted vote patterns (v_<rule>, n).

    A rule that would vote bad less often on bad texts than on good ones is held to say nothing, so
    that good and bad don't change places.
    """
    rows = patterns.select("n", *(f"v_{r}" for r in rules)).collect()  # 3 ** len(rules) at most
    ballots = [(row["n"], [(r, row[f"v_{r}"]) for r in rules if row[f"v_{r}"] is not None]) for row in sorted(rows, key=str)]
    now = Accuracies(FIRST_SHARE, dict.fromkeys(rules, FIRST_BAD), dict.fromkeys(rules, FIRST_GOOD))
    total = sum(n for n, _ in ballots)
    for _ in range(ROUNDS):
        weights = {r: now.weights(r) for r in rules}
        counts = {(r, v, k): 0.0 for r in rules for v in (0, 1) for k in ("bad", "good")}
        good = 0.0
        for n, votes in ballots:
            p = 1 / (1 + math.exp(-min(max(now.start + sum(weights[r][v] for r, v in votes), -500), 500)))
            good += n * p
            for r, v in votes:
                counts[r, v, "good"] += n * p
                counts[r, v, "bad"] += n * (1 - p)
        share = min(max((good + STRENGTH * FIRST_SHARE) / (total + STRENGTH), LEAST_SHARE), MOST_SHARE)
        new = Accuracies(share, {}, {})
        for r in rules:
            of = lambda k, r=r: counts[r, 0, k] + counts[r, 1, k]
            new.bad[r] = (counts[r, 0, "bad"] + STRENGTH * FIRST_BAD) / (of("bad") + STRENGTH)
            new.good[r] = (counts[r, 1, "good"] + STRENGTH * FIRST_GOOD) / (of("good") + STRENGTH)
            if new.bad[r] < 1 - new.good[r]:
                new.bad[r] = (counts[r, 0, "bad"] + counts[r, 0, "good"]) / (of("bad") + of("good"))
                new.good[r] = 1 - new.bad[r]
            new.bad[r], new.good[r] = (min(max(x, LEAST_RATE), 1 - LEAST_RATE) for x in (new.bad[r], new.good[r]))
        moved = max(abs(x - y) for r in rules for x, y in ((new.bad[r], now.bad[r]), (new.good[r], now.good[r])))
        now = new
        if moved < 1e-6:
            break
    return now


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows of 8 words.  kept:
    not base_failed, and the posterior probability of a good text is at least one half.  The
    accuracies are those on the texts that do not fail the base.

    Null and empty texts have counts of 0 and fail; very long ones are counted whole.  A posterior
    of one half is good.  Each row is judged alone, repeated rows alike; only text and doc_id are
    read, whatever other columns are named.  An empty table gives an empty result.
    """
    rules = votes()
    counted = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    scratch = Scratch(spark, "rules")
    counted = scratch.keep("counted", counted.withColumns({f"v_{r}": v for r, v in rules.items()}))
    n = F.col("n_words")
    counted = counted.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n))
    patterns = counted.where(~F.col("base_failed")).groupBy(*(f"v_{r}" for r in rules)).agg(F.count("*").alias("n"))
    accuracy = estimate(patterns, list(rules))
    out = counted.withColumn("posterior", posterior(list(rules), accuracy))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
