"""The main text of web pages, by a maximum-scoring run of words and tags.

A page is a sequence of tokens.  Words score positive and tags negative, with weights learned
from labelled pages: pages whose author marked the content with ``<article>`` or ``<main>`` say
which tokens are content, and a token class weighs what its odds of being content are.  Parts
that are never content (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments) are left out of the sequence.  One scan finds the contiguous run with the largest sum;
the run's blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The training sample: so many pages with a marked content element at most, in hashed order.
SAMPLE_PAGES = 300

# fixed values
BLOCKS = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside audio button canvas datalist footer form head header iframe input label map menu nav noscript object option script select style svg template textarea video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is never content.
NEVER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie copyright cookies discussion disqus footer gdpr header legal links login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets".split()
)
#: Words of a class or id that say what a part has beside it, or lacks, and not what it is.
RELATIONS = frozenset("has have having with without no not non enabled disabled fixed sticky open closed active visible layout theme template".split())
#: Words that say where a part stands or what it is made of, and nothing of what it holds.
PLACES = frozenset("area articles bar block bottom box center col column container full global group holder inner item items left list lower main outer page panel posts primary region right row secondary section site stories sub top upper user wrap wrapper".split())
#: Words that say that a part holds what readers wrote, however long it is.
TALK = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Words that say that a part is the content.
CONTENT = frozenset("content main article body entry post text story".split())
#: Elements of running text: names that say something else too do not hide these.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td figure".split())
#: A part whose name says something else too is content if it holds so many words, or this share of the page's.
PROSE_WORDS, PROSE_SHARE = 80, 1 / 3
MARKED = frozenset(["article", "main"])
#: Why a part is never content: its tag or that it is not displayed, a name that says something else
#: too, such a name that speaks of readers' comments, a name that says only that.
SURE, MIXED, TALKED, NAMED = 1, 2, 3, 4
#: Ends of elements whose end tag authors leave out: a tag of the key closes these.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: What follows a tag's name: a quote opens a value only after "=" and where it is closed again.
#: Nothing is given back once read, and the page's end ends a tag, so that a scan is linear.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    rf"<!--(?P<comment>.*?)(?:-->|\Z)|<svg(?=[\s/>]){_ATTRS}(?<=/)>|<(?P<raw>script|style|textarea|noscript|template|iframe|svg|title)(?=[\s/>]){_ATTRS}(?:>|\Z)(?:.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: An attribute's name and its value, which is read as a whole, so that nothing in it is a name.
_ATTR = re.compile(r"([^\s\"'=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(\S++)))?")
#: The slash of an element that closes itself, which an unquoted value's last letter is not.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*+\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

#: A token's class (of words: the link or else the block that they stand in), its text, its block's number.
Token = tuple[str, str, int]


def _named(word: str) -> list[str]:
    """A word of a name, or the two known words that it is made of ("usercomments")."""
    known = NEVER_WORDS | PLACES
    if word not in known:
        for i in range(2, len(word) - 1):
            if word[:i] in known and word[i:] in known:
                return [word[:i], word[i:]]
    return [word]


@lru_cache(1 << 14)
def _why(names: str) -> int:
    """MIXED, TALKED or NAMED by the words of class, id and role, or 0."""
    why, content, talk = 0, False, False
    for token in names.split():
        words = [w for part in _PART.findall(token) for w in _named(part.lower())]
        content |= not CONTENT.isdisjoint(words)
        talk |= not TALK.isdisjoint(words)
        if not RELATIONS.isdisjoint(words) or NEVER_WORDS.isdisjoint(words):
            continue
        mixed = not (NEVER_WORDS | PLACES).issuperset(words)
        why = max(why, (MIXED if TALK.isdisjoint(words) else TALKED) if mixed else NAMED)
    return MIXED if why == NAMED and content and not talk else why


def never_shown(tag: str, attrs: str) -> int:
    """SURE, MIXED, TALKED or NAMED where the element is never content, or 0."""
    if tag in NEVER:
        return SURE
    if tag in ("body", "html", "article", "main") or not attrs:
        return 0
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        return SURE
    why = _why(" ".join(values.get(name, "") for name in ("class", "id", "role")))
    return 0 if why == MIXED and tag in PROSE else why


@dataclass
class _Part:
    """What a name hides: why, the marked element in it, whether it lies in one, its words outside and inside links."""

    why: int
    within: bool
    holds: str = ""
    words: int = 0
    linked: int = 0


def tokens(page: str) -> tuple[list[Token], list[bool]]:
    """The page's tokens without what is never content, and whether each lies in a marked element.

    Parts whose name says something else too are opened if they hold prose: more words than
    links have, and PROSE_WORDS of them or PROSE_SHARE of the page's; where a marked element is shown,
    only parts inside such a one.  Where every marked element lies in parts that only a name hides,
    those are opened: any with ``<main>`` or a mixed name, and if no word is left then all.  So are, where
    no marked element is shown, parts of any mixed name that hold most of the page's words.
    """
    out, marks, parts, shown = _read(page, frozenset())
    if parts:
        marked = any(marks)
        every = shown + sum(p.words for p in parts.values() if not p.why & _NESTED)
        opened = set()
        for number, p in parts.items():
            mixed = p.why & ~_NESTED
            prose = p.words > p.linked and (p.words >= PROSE_WORDS or p.words >= PROSE_SHARE * every)
            if mixed == MIXED and prose and (p.within or not marked):
                opened.add(number)
            elif not marked and (mixed in (MIXED, TALKED) and 2 * p.words > every or p.holds and (not shown or mixed in (MIXED, TALKED) or p.holds == "main")):
                opened.add(number)
        if opened:
            out, marks, *_ = _read(page, frozenset(opened))
    return out, marks


#: Set beside the reason of a part that lies in another that a name hides.
_NESTED = 8


def _read(page: str, opened: frozenset[int]) -> tuple[list[Token], list[bool], dict[int, _Part], int]:
    """Tokens, marks, the parts that a name hides by their tag's number, and the words shown outside links.

    Words are counted once along the page; a part's are the difference between its end and its start.
    """
    out: list[Token] = []
    marks: list[bool] = []
    open_: list[tuple[str, int, str, int]] = []  # tag, why it is never content, the link or block it lies in or is, its number
    n_open = Counter()
    hidden = marked = block = sure = shown = 0
    said = linked = 0  # words in parts that names hide, outside and inside links
    parts: dict[int, _Part] = {}
    hiding: list[int] = []  # numbers of the open ones

    def close() -> str:
        nonlocal hidden, marked, sure
        t, why, _, number = open_.pop()
        n_open[t] -= 1
        marked -= t in MARKED
        if why:
            hidden -= 1
            sure -= why == SURE
        if why > SURE:
            hiding.pop()
            parts[number].words += said
            parts[number].linked += linked
        return t

    for number, m in enumerate(_TOKEN.finditer(page), 1):
        if m["text"] is not None:
            where = open_[-1][2] if open_ else ""
            if not hidden:
                out.append((f"w:{where}", m["text"], block))
                marks.append(marked > 0)
            if not sure and (hidden or where != "a"):
                n = len(m["text"].split())
                if not hidden:
                    shown += n
                elif where == "a":
                    linked += n
                else:
                    said += n
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            was_hidden = hidden
            while n_open[tag]:
                if close() == tag:
                    break
            block += tag in BLOCKS
            if not was_hidden and tag not in NEVER:
                out.append((f"/{tag}", "", block))
                marks.append(marked > 0)
            continue
        while open_ and open_[-1][0] in CLOSES.get(tag, ()):
            close()
        block += tag in BLOCKS
        # the header of an article or of the main part has its title
        never = 0 if tag in VOID or number in opened else never_shown("div" if tag == "header" and (n_open["article"] or n_open["main"]) else tag, m["attrs"])
        if not hidden and not never and tag not in NEVER:
            out.append((tag, " " if tag == "br" else "", block))
            marks.append(marked > 0)
        if tag in MARKED and hidden and not sure:
            for k in reversed(hiding):
                if parts[k].holds in (tag, "main"):
                    break  # and so do those around it
                parts[k].holds = tag
        if tag not in VOID and not _CLOSED.search(m["attrs"]):
            inside = tag if tag in BLOCKS or tag == "a" else open_[-1][2] if open_ else ""
            open_.append((tag, never, inside, number))
            n_open[tag] += 1
            marked += tag in MARKED
            if never:
                hidden += 1
                sure += never == SURE
            if never > SURE:
                parts[number] = _Part(never | (_NESTED if hiding else 0), marked > 0, "", -said, -linked)
                hiding.append(number)
    while open_:
        close()
    return out, marks, parts, shown


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            found, marks = tokens(page)
            for (kind, text, _), mark in zip(found, marks, strict=True):
                (inside if mark else outside)[kind] += max(1, len(text.split())) if kind.startswith("w:") else 1
    kinds = sorted(inside | outside)
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], ["kind", "inside", "outside"])


#: Used for classes that no labelled page has.
WORD_WEIGHT, TAG_WEIGHT = 1.0, -0.1
#: A link's text weighs the same in every page and however long, less than the tags around it.
LINK_WEIGHT = 0.15


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """The weight of each token class: log odds of content, positive for words and negative for tags."""
    known = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html", F.xxhash64("html").alias("h"))
    # hashes first, so that no task holds many whole pages; copies count once
    last = known.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h").alias("h")).first()["h"]
    counts = known.where(F.col("h") <= (last or 0)).dropDuplicates(["h"]).select("html").mapInArrow(_count, "kind string, inside bigint, outside bigint").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # a row for each tag name of the sample's pages
    rows = counts.collect()
    weights = {}
    for r in rows:
        odds = float(np.log((r["inside"] + 1) / (r["outside"] + 1)))
        weights[r["kind"]] = min(max(odds, 0.1), 3.0) if r["kind"].startswith("w:") else max(min(odds, -0.1), -3.0)
    return weights


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """The first longest run with the largest sum, as a half-open range; empty if no sum is positive."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - lowest)) + 1
    if sums[end] - lowest[end - 1] <= 0:
        return 0, 0
    return int(np.argmin(sums[:end])), end


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks of the best run, white space as one space, joined by one newline."""
    found, _ = tokens(page or "")
    scores = np.zeros(len(found))
    for i, (kind, text, _) in enumerate(found):
        if kind.startswith("w:"):
            n = len(text.split())
            scores[i] = LINK_WEIGHT * min(n, 1) if kind == "w:a" else weights.get(kind, WORD_WEIGHT) * n
        else:
            scores[i] = weights.get(kind, TAG_WEIGHT)
    first, end = best_run(scores)
    blocks: dict[int, list[str]] = {}
    for _, text, block in found[first:end]:
        if text:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(map(html.unescape, parts))).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(weights: dict[str, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null or empty html, or html without content, has the text "" and n_chars 0.  Each row is
    read alone and whole, however long; repeated rows get equal answers.  Of runs with equal sums
    the first and longest counts.  Weights come from the table's own
    pages with marked content; without any, every word weighs 1 and every tag -0.1.  Other columns
    are ignored; an empty table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    return pages.mapInArrow(partial(_extract, learn_weights(pages)), "page_id bigint, url string, text string, n_chars bigint")
