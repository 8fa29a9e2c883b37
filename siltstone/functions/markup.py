"""Cleaning of question and answer HTML: sanitised markup, text blocks, code and its language.

Python reads the tags of a page into marked pieces of raw text and nothing else; blocks, white
space, prefixes, fences, limits and the text are Column expressions over those pieces.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fence, normalize_text

# fixed values
DROPPED = frozenset(["script", "style", "iframe", "object", "embed", "svg", "math"])
ALLOWED = frozenset("a b blockquote br code em h1 h2 h3 h4 h5 h6 i li ol p pre strong ul".split())
KINDS = {"blockquote": "quote", "ul": "list", "ol": "list", "pre": "code", "p": "paragraph", "li": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}
VOID = frozenset(["br", "hr", "img", "embed", "input", "meta", "link"])
#: Elements before which an open paragraph ends.
BREAKS = frozenset([*KINDS, "div", "table", "section", "article", "form", "hr"])
LANGUAGE = re.compile(r"(?:language-|lang-)([a-zA-Z0-9_+#.-]{1,30})")
SAFE = re.compile(r"(?i)\s*https?://[^/?#\s]")

PIECE = "struct<block:int,kind:string,prefix:string,text:string,language:string>"


def _language(attrs: dict[str, str | None]) -> str | None:
    found = (LANGUAGE.fullmatch(c) for c in (attrs.get("class") or "").split())
    return next((m[1].casefold() for m in found if m), None)


class _Pieces(HTMLParser):
    """pieces (block, kind, prefix, text, language) and the sanitised markup of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[int, str, str, str, str | None]] = []
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropped: list[str] = []
        self.block = ""  # the tag of the open block
        self.depth = self.items = 0  # of lists in a list, and its items
        self.text: list[str] | None = None  # of the open block, or of the list's open item
        self.marks: list[tuple[str, int, str]] = []  # open links and code: tag, where its text begins, address
        self.language: str | None = None

    def _emit(self) -> None:
        """The open block's (or item's) text as a piece."""
        if self.text is not None and self.block:
            prefix = {"ul": "- ", "ol": f"{self.items}. "}.get(self.block, "#" * int(self.block[1]) + " " if KINDS[self.block] == "heading" else "")
            self.pieces.append((self.n, KINDS[self.block], prefix, "".join(self.text), self.language))
        self.text = None

    def _end(self) -> None:
        while self.marks:
            self._unmark()
        self._emit()
        self.block, self.language = "", None

    def _unmark(self) -> None:
        tag, start, href = self.marks.pop()
        if self.text is None or start > len(self.text):
            return
        inner = "".join(self.text[start:])
        if tag == "code":
            ticks = "``" if "`" in inner else "`"
            self.text[start:] = [f"{ticks}{inner}{ticks}"]
        else:
            self.text[start:] = [f"[{inner.strip()}]({href})" if href else inner.strip()]

    n = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped or tag in DROPPED:
            if tag not in VOID:
                self.dropped.append(tag)
            return
        named = dict(attrs)
        href = (named.get("href") or "").strip() if SAFE.match(named.get("href") or "") else ""
        if self.block in ("p", "li") and tag in BREAKS:
            self._end()
        if tag in ALLOWED:
            language = _language(named) if tag == "code" else None
            self.out.append(f"<{tag}" + (f' href="{html.escape(href)}"' if tag == "a" and href else f' class="language-{language}"' if language else "") + ">")
        if tag not in VOID:
            self.open.append(tag)
        if not self.block and tag in KINDS:
            self.n += 1
            self.block, self.depth, self.items = tag, 1, 0
            self.text, self.language = (None if tag in ("ul", "ol") else []), _language(named) if tag == "pre" else None
        elif self.block in ("ul", "ol") and tag in ("ul", "ol"):
            self.depth += 1
        elif self.block in ("ul", "ol") and tag == "li" and self.depth == 1:
            self._emit()
            self.items, self.text = self.items + 1, []
        elif self.block == "pre":
            self.language = self.language or (_language(named) if tag == "code" else None)
        elif self.text is not None and tag == "br":
            self.text.append("\n")
        elif self.text is not None and tag in ("a", "code"):
            self.marks.append((tag, len(self.text), href))

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            return
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            if top in ALLOWED:
                self.out.append(f"</{top}>")
            if self.marks and self.marks[-1][0] == top:
                self._unmark()
            elif top in ("ul", "ol") and self.block in ("ul", "ol"):
                self.depth -= 1
                if not self.depth:
                    self._end()
            elif top == "li" and self.block in ("ul", "ol") and self.depth == 1:
                self._emit()
            elif top == self.block and self.block not in ("ul", "ol"):
                self._end()
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        self.out.append(html.escape(data, quote=False))
        if self.text is not None:
            self.text.append(data)
        elif not self.block:  # each text outside of blocks is a paragraph of its own
            self.n += 1
            self.pieces.append((self.n, "paragraph", "", data, None))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("block", pa.int32()), ("kind", pa.string()), ("prefix", pa.string()), ("text", pa.string()), ("language", pa.string())])
    for batch in batches:
        pieces, sanitized = [], []
        for source in batch.column("html").to_pylist():
            page = _Pieces()
            if source is not None:
                page.feed(unicodedata.normalize("NFC", source).replace("\x00", ""))
                page.close()
            while page.open:
                page.handle_endtag(page.open[-1])
            page._end()
            pieces.append([dict(zip((f.name for f in kind), p, strict=True)) for p in page.pieces])
            sanitized.append("".join(page.out).strip())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pieces, pa.list_(kind)), pa.array(sanitized, pa.string())], ["id", "pieces", "sanitized"])


def blocks(pieces: Column) -> Column:
    """(kind, text, language) of each block that has text, from a page's pieces in order."""

    def shown(p: Column) -> Column:
        text = normalize_text(p["text"])
        code = F.regexp_replace(F.regexp_replace(p["text"], r"\r\n?", "\n"), r"^\n+|\n+$", "")
        fenced = F.concat(fence(code), F.coalesce(p["language"], F.lit("")), F.lit("\n"), code, F.lit("\n"), fence(code))
        quoted = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
        body = F.when((p["kind"] == "code") & (code != ""), fenced).when((p["kind"] != "code") & (text != ""), F.when(p["kind"] == "quote", quoted).otherwise(F.concat(p["prefix"], text)))
        return F.struct(p["block"].alias("block"), p["kind"].alias("kind"), body.alias("text"), p["language"].alias("language"))

    known = F.filter(F.transform(pieces, shown), lambda p: p["text"].isNotNull())
    none = F.array().cast("array<struct<block:int,kind:string,text:string,language:string>>")

    def join(done: Column, p: Column) -> Column:
        """The items of a list are one block."""
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(p["block"].alias("block"), p["kind"].alias("kind"), F.concat_ws("\n", last["text"], p["text"]).alias("text"), p["language"].alias("language"))
        return F.when(last["block"] == p["block"], F.array_append(F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1)), both)).otherwise(F.array_append(done, p))

    return F.transform(F.aggregate(known, none, join), lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["language"].alias("language")))


def cleaned(pages: DataFrame, key: str, source: str, max_bytes: int = 1_000_000, max_chars: int = 200_000) -> DataFrame:
    """key, text, sanitized, has_code, blocks and error of each row; what is too large has an error code and nothing else.

    Null and empty pages have no text and no error; has_code tells of code blocks, not of code in
    a line.
    """
    own = pages.select(F.col(key).cast("bigint").alias("id"), F.expr(source).alias("html")).select("id", F.when(F.octet_length("html") <= max_bytes, F.col("html")).alias("html"), (F.octet_length("html") > max_bytes).alias("large"))
    rows = own.select("id", "html").where("html IS NOT NULL").mapInArrow(_read, f"id bigint, pieces array<{PIECE}>, sanitized string")
    rows = rows.select("id", blocks(F.col("pieces")).alias("blocks"), "sanitized").withColumn("text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"))
    rest = own.where("html IS NULL").select("id", F.array().cast("array<struct<kind:string,text:string,language:string>>").alias("blocks"), F.lit("").alias("sanitized"), F.lit("").alias("text"), F.when(F.col("large"), "HTML_TOO_LARGE").alias("error"))
    all_ = rows.withColumn("error", F.when(F.length("text") > max_chars, "CLEANED_CONTENT_TOO_LARGE")).unionByName(rest)
    fits = F.col("error").isNull()
    return all_.select(
        F.col("id").alias(key), F.when(fits, F.col("text")).otherwise("").alias("text"), F.when(fits, F.col("sanitized")).otherwise("").alias("sanitized"),
        (fits & F.exists("blocks", lambda b: b["kind"] == "code")).alias("has_code"), F.when(fits, F.col("blocks")).otherwise(F.array()).alias("blocks"), "error",
    )


def clean_title(source: str | None, limit: int = 500) -> str:
    """The text of a title: markup and entities resolved, on one line, cut."""
    text = html.unescape((source or "").replace("\r\n", "\n"))
    text = unicodedata.normalize("NFC", re.sub(r"<[^>]*>", " ", text))
    return re.sub(r"\s+", " ", text).strip()[:limit].strip()
