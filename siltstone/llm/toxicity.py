"""Toxic texts, from a lexicon that also catches misspelled terms, read in context.

The lexicon holds seed terms and the words and word beginnings that labelled toxic texts have
much more often than others.  A Damerau-Levenshtein automaton of each distinct word of a text is
intersected with the trie of whole terms, so that a term with one wrong, missing, extra or
swapped letter is found without comparing it with every term.  A hit counts less where its
window of words shows a quotation and more where it is addressed to somebody or stands among
other hits.  A logistic model over the hits' scores gives the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.language import held_out
from siltstone.llm.scratch import Scratch

#: The training sample: so many labelled documents at most, in hashed order.  One half teaches
#: the lexicon, the other the weights.
SAMPLE_DOCS = 8000
THRESHOLD = 0.3
LEAST_SUPPORT = 4
LEAST_WORDS = 4
LEAST_LOG_ODDS = 1.6
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Shorter terms are matched exactly.
FUZZY_LENGTH = 5
WINDOW = 8
CACHED_WORDS = 500_000

# fixed values
SEED_TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset("said says wrote called quote quoted quoting word term sagte schrieb zitat zitiert dit écrit cité mot dijo escribió cita citado palabra".split())
ADDRESS = frozenset("you your you're u ur du dich dir ihr euch tu te toi vous tú ti usted ustedes".split())
QUOTES = "\"“”„«»‘’‹›"
EDGES = " \t\r\n.,;:!?()[]{}<>|#$%&*+=~^`'_-/\\" + QUOTES
INSIDE = re.compile(r"(?<=[^\W_])(?:[^\w\s]|_)+(?=[^\W_])")
SEED_WEIGHT = 3.0
#: What a misspelled term weighs, as a part of the term's weight, before documents show what it weighs.
NEAR_PART = 0.6
#: Documents for which that first guess counts.
NEAR_SUPPORT = 4
#: A word within one error of a term that so many times as many toxic texts have is that term misspelled.
RARER = 3


class Trie:
    """children: a dict per node; term: the index of the term that ends there, or -1."""

    def __init__(self, terms: list[str]):
        self.children, self.term = [{}], [-1]
        for k, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                at = self.children[at][c]
            self.term[at] = k


def start_states() -> frozenset:
    """Automaton states are (place in the word, errors, whether a swap is half read)."""
    return frozenset([(0, 0, False)])


def step(word: str, states: frozenset, c: str, most: int = 1) -> frozenset:
    """The states after reading c, for the automaton that accepts what is within ``most`` errors of word."""
    n, out = len(word), set()
    for at, errors, swap in states:
        if swap:
            if word[at] == c:
                out.add((at + 2, errors, False))
            continue
        if at < n and word[at] == c:
            out.add((at + 1, errors, False))
        if errors < most:
            out.add((at, errors + 1, False))  # c is missing in the word
            if at < n:
                out.add((at + 1, errors + 1, False))  # another letter stands for c
                if at + 1 < n and word[at + 1] == c:
                    out.add((at, errors + 1, True))
        for skip in range(1, most - errors + 1):  # the word has extra letters here
            if at + skip < n and word[at + skip] == c:
                out.add((at + skip + 1, errors + skip, False))
    return frozenset(out)


def accepts(word: str, states: frozenset, most: int = 1) -> int:
    """The fewest errors of an accepting state, or -1."""
    return min((e + len(word) - at for at, e, swap in states if not swap and e + len(word) - at <= most), default=-1)


#: Transitions by states (relative to the letters read), which of four letters of the word equal
#: the one read, and how many letters are left (3: or more): the same for all words.
_MOVES: dict[tuple[frozenset, int, int], frozenset] = {}


def _move(states: frozenset, equal: int, left: int) -> frozenset:
    """One step over a word of which only equality with the letter read is known."""
    word = "".join("=" if equal >> j & 1 else "." for j in range(left + 1))
    return frozenset((at - 2, errors, swap) for at, errors, swap in step(word, frozenset((at + 1, errors, swap) for at, errors, swap in states), "="))


def within_one(word: str, trie: Trie) -> list[tuple[int, int]]:
    """(term, errors) of the trie's terms within one error of the word."""
    n, padded, found, stack = len(word), f"\0{word}\0\0\0", [], [(0, start_states(), 0)]
    children, term = trie.children, trie.term
    while stack:
        node, states, depth = stack.pop()
        if term[node] >= 0 and (errors := min((e + n - depth - at for at, e, swap in states if not swap), default=9)) <= 1:
            found.append((term[node], errors))
        left = min(n - depth, 3)
        if left < -1:
            continue
        one, two, three, four = padded[depth], padded[depth + 1 : depth + 2], padded[depth + 2 : depth + 3], padded[depth + 3 : depth + 4]
        for c, child in children[node].items():
            key = states, (one == c) | (two == c) << 1 | (three == c) << 2 | (four == c) << 3, left
            after = _MOVES.get(key)
            if after is None:
                after = _MOVES[key] = _move(*key)
            if after:
                stack.append((child, after, depth + 1))
    return found


def letters(word: str) -> int:
    """The set of a word's letters, as 64 bits that letters may share."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Lexicon:
    """Whole terms and stems (beginnings of words) with weights."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: set[str], near: dict[str, float] | None = None):
        """fuzzy: the terms that are looked for misspelled; near: what they weigh then, if not NEAR_PART of what they weigh."""
        self.terms, self.stems = terms, stems
        self.near = {t: NEAR_PART * terms[t] for t in fuzzy} | (near or {})
        self.fuzzy = [t for t in sorted(fuzzy) if len(t) >= FUZZY_LENGTH]
        # One error touches two neighbouring letters at most, so that the longer of what stands
        # before and after it, at least (length - 1) // 2 letters, is whole: a branch of the trie
        # for each length and such beginning or end.
        halves: dict[int, tuple[dict[str, list[str]], dict[str, list[str]]]] = {}
        for t in self.fuzzy:
            half = (len(t) - 1) // 2
            heads, tails = halves.setdefault(len(t), ({}, {}))
            heads.setdefault(t[:half], []).append(t)
            tails.setdefault(t[-half:], []).append(t)
        branch = lambda ts: (ts, Trie(ts), [letters(t) for t in ts])
        branches = {n: ((n - 1) // 2, *({k: branch(ts) for k, ts in side.items()} for side in sides)) for n, sides in halves.items()}
        #: By a word's length: the half length, beginnings and ends of terms of nearly that length.
        self.branches = {n: [branches[m] for m in (n - 1, n, n + 1) if m in branches] for k in branches for n in (k - 1, k, k + 1)}
        self.stem_lengths = sorted({len(s) for s in stems})
        self.cache: dict[str, tuple[float, int] | None] = {}
        self.seen: dict[str, tuple | None] = {}

    def look_up(self, token: str) -> tuple[float, int] | None:
        """(weight, errors) of the best entry for a lower-case token, or None."""
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        self.cache[token] = found = self._find(token.strip(EDGES))
        return found

    def read(self, token: str) -> tuple | None:
        """None for a token without a hit, (its hit,), or its parts between punctuation where one of them is a hit and the whole is none."""
        hit = self._find(token.strip(EDGES))
        if hit is not None:
            return (hit,)
        if not token.isalnum() and len(parts := tuple(INSIDE.split(token))) > 1 and any(self.look_up(p) for p in parts):
            return parts
        return None

    def _find(self, word: str) -> tuple[float, int] | None:
        if len(word) < 3:
            return None
        best = (self.terms[word], 0) if word in self.terms else None
        for n in self.stem_lengths:
            if n > len(word):
                break
            weight = self.stems.get(word[:n])
            if weight is not None and (best is None or weight > best[0]):
                best = (weight, 0)
        return best or max(((self.near[t], errors) for t, errors in self.near_terms(word)), default=None)

    def near_terms(self, word: str) -> list[tuple[str, int]]:
        """(term, errors) of the terms that are looked for misspelled and within one error of the word."""
        own, found = 0, {}
        for half, heads, tails in self.branches.get(len(word), ()):
            for branch in (heads.get(word[:half]), tails.get(word[-half:])):
                if branch is None:
                    continue
                own = own or letters(word)
                for m in branch[2]:
                    if (own ^ m).bit_count() <= 2:  # an error replaces one letter by another at most
                        found.update((branch[0][k], errors) for k, errors in within_one(word, branch[1]))
                        break
        return list(found.items())

    def features(self, text: str | None) -> list[float]:
        """1, and how much, how strong and how dense the hits are, and the text's length; all 0 without any."""
        tokens, seen = (text or "").lower().split(), self.seen
        if len(seen) >= CACHED_WORDS:
            seen.clear()
        found, apart = {}, {}
        for t in set(tokens):
            if t not in seen:
                seen[t] = self.read(t)
            if (read := seen[t]) is None:
                continue
            if len(read) == 1:
                found[t] = read[0]
            else:
                apart[t] = read
        if apart:
            tokens = [p for t in tokens for p in apart.get(t, (t,))]
            found |= {p: hit for parts in apart.values() for p in parts if (hit := self.look_up(p)) is not None}
        if not found:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        places = [i for i, t in enumerate(tokens) if t in found]
        total = most = 0.0
        for j, i in enumerate(places):
            weight, _ = found[tokens[i]]
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            opened = sum(t[0] in QUOTES for t in near[: WINDOW + 1]) and sum(t.rstrip(".,;:!?")[-1:] in QUOTES and len(t.rstrip(".,;:!?")) > 0 for t in near)
            reported = any(t.strip(EDGES) in REPORTING for t in near)
            addressed = any(t.strip(EDGES) in ADDRESS for t in near)
            crowd = sum(abs(places[k] - i) <= WINDOW for k in (j - 1, j + 1) if 0 <= k < len(places))
            score = weight * (0.35 if opened else 1.0) * (0.7 if reported and not addressed else 1.0) * (1 + 0.25 * crowd + 0.25 * addressed)
            total, most = total + score, max(most, score)
        return [1.0, float(np.log1p(total)), most, float(np.log1p(100 * total / max(len(tokens), 20))), float(np.log1p(len(tokens)))]


def _features(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [lexicon.features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    a = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(a))
        a = a - np.linalg.solve(hessian, x.T @ (p - y) + ridge * a)
    return a


def _near_forms(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n1, n0) of each word that is no entry itself and within one error of a term."""
    for batch in batches:
        rows = []
        for word, n1, n0 in zip(*(batch.column(c).to_pylist() for c in ("term", "n1", "n0")), strict=True):
            if word not in lexicon.terms and not any(word[:n] in lexicon.stems for n in lexicon.stem_lengths):
                rows += [(term, n1, n0) for term, _ in lexicon.near_terms(word)]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["term", "n1", "n0"])


def learn_lexicon(sample: DataFrame, scratch: Scratch | None = None, name: str = "words") -> Lexicon:
    """From (label, text): seeds, and what is far more frequent in texts of label 1.

    Document frequencies of words are counted in Spark, and those of stems are the sums over
    their words; a stem needs LEAST_WORDS different ones.  Only entries past the thresholds
    reach the driver; the sample bounds them.  A seed that the sample has in LEAST_SUPPORT
    documents weighs what it shows there, any other SEED_WEIGHT; so do misspelled terms, from
    NEAR_PART of their term's weight on, and where that shows no odds, the term is not looked
    for misspelled.  A word that is a term misspelled (RARER, within one error) is no entry of its
    own: the automata find it, and its counts are its term's.
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    trimmed = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES)))
    words = F.filter(F.array_union(trimmed, F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 3)
    counts = sample.select("label", F.explode(words).alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    counts = (scratch or Scratch(sample.sparkSession, "toxicity")).keep(name, counts)
    beginnings = F.transform(F.filter(F.array(*map(F.lit, STEM_LENGTHS)), lambda k: F.length("term") > k), lambda k: F.col("term").substr(F.lit(1), k))
    stems = counts.select("n1", "n0", F.explode(beginnings).alias("term")).groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.col("n1") > 0).alias("k")).where(F.col("k") >= LEAST_WORDS)

    odds = F.log((F.col("n1") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("n0") + 0.5) / (n.get(0, 0) + 1))
    seed = F.col("term").isin(*SEED_TERMS)

    def best(found: DataFrame) -> list:
        telling = (F.col("n1") >= LEAST_SUPPORT) & (F.col("odds") >= LEAST_LOG_ODDS)
        return found.withColumn("odds", odds).where(telling | (seed & (F.col("n1") + F.col("n0") >= LEAST_SUPPORT))).select("term", "odds", "n1").collect()

    kept: dict[str, float] = {}
    for r in sorted(best(stems), key=lambda r: (len(r["term"]), r["term"])):
        if not any(kept.get(r["term"][:k], -9) >= r["odds"] - 0.7 for k in STEM_LENGTHS):
            kept[r["term"]] = float(r["odds"])
    words = best(counts)
    terms = dict.fromkeys(SEED_TERMS, SEED_WEIGHT) | {r["term"]: float(r["odds"]) for r in words}
    support = dict.fromkeys(SEED_TERMS, 0) | {r["term"]: r["n1"] for r in words}
    terms = {t: w for t, w in terms.items() if w > 0}
    first = Lexicon(terms, kept, set(terms))
    misspelled = {t for t in terms if t not in SEED_TERMS and any(errors and support[o] >= RARER * support[t] and terms[o] >= terms[t] - 0.7 for o, errors in first.near_terms(t))}
    terms = {t: w for t, w in terms.items() if t not in misspelled}
    first = Lexicon(terms, kept, set(terms))
    found = counts.mapInArrow(partial(_near_forms, first), "term string, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    near = {}
    for r in found.withColumn("odds", odds).collect():
        seen = r["n1"] + r["n0"]
        near[r["term"]] = (NEAR_SUPPORT * first.near[r["term"]] + seen * r["odds"]) / (NEAR_SUPPORT + seen)
    return Lexicon(terms, kept, {t for t in terms if near.get(t, 1.0) > 0}, near)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the logistic weights; without two classes, seeds and fixed weights."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("label", "text", half.alias("half"))
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep("sample", sample)
    rows = sample.where("half = 1").select("label", "text").mapInArrow(partial(_features, learn_lexicon(sample.where("half = 0"), scratch, "half")), "label int, x array<double>").collect()
    lexicon = learn_lexicon(sample, scratch, "words")
    scratch.drop("sample", "half", "words")
    y = np.array([r["label"] for r in rows], float)
    if len(np.unique(y)) < 2:
        return lexicon, np.array([-4.0, 1.0, 0.5, 1.0, 0.0])
    return lexicon, logistic(np.array([r["x"] for r in rows]), y)


def _score(lexicon: Lexicon, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(weights))
        score = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def toxicity_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Learns from labels (doc_id, toxic) of documents that are not held out (crc32 of doc_id as
    text leaves 2 modulo 4); a document with several labels counts with the largest.  Null and
    empty texts have no hits and get the score of that.  A null doc_id is neither learned from
    nor held out.  Very long texts are read whole; repeated rows get equal scores.  Where several
    terms are near a word, the heaviest counts.  Other columns are ignored; an empty table gives an
    empty result.
    """
    lexicon, weights = train(spark, docs, labels)
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, lexicon, weights), "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
