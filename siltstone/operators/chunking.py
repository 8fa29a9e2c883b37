"""Splitting texts into chunks of bounded tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip, token_count


def blocks(text: Column) -> Column:
    """Non-blank lines with their tokens."""
    lines = F.filter(F.split(text, "\n"), lambda b: F.trim(b) != "")
    return F.transform(lines, lambda b: F.struct(b.alias("text"), token_count(b).cast("int").alias("n")))


def pack(blocks_: Column, target: int, most: int, least: int) -> Column:
    """Greedy chunks (first block, last block, tokens) of an array of struct(text, n).

    A block that would pass the target closes the chunk before it; a chunk of ``least`` tokens
    or fewer joins the one before it while the two stay within ``most``.
    """
    chunk = lambda a, b, n: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<a:int,b:int,n:int>>")

    def flush(done: Column, last: Column) -> Column:
        before = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (last["n"] < least) & (F.coalesce(F.try_element_at(done, F.lit(-1))["n"], F.lit(0)) + last["n"] <= most)
        return F.when(last["n"] == 0, done).when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(chunk(before["a"], last["b"], before["n"] + last["n"])))).otherwise(F.concat(done, F.array(last)))

    def step(acc: Column, block: Column) -> Column:
        now, i = acc["now"], acc["i"]
        full = (now["n"] > 0) & (now["n"] + block["n"] > target)
        done = F.when(full, flush(acc["done"], now)).otherwise(acc["done"])
        grown = F.when(full | (now["n"] == 0), chunk(i, i, block["n"])).otherwise(chunk(now["a"], i, now["n"] + block["n"]))
        return F.struct(done.alias("done"), grown.alias("now"), (i + 1).alias("i"))

    start = F.struct(none.alias("done"), chunk(F.lit(0), F.lit(0), F.lit(0)).alias("now"), F.lit(0).alias("i"))
    return F.aggregate(blocks_, start, step, lambda acc: flush(acc["done"], acc["now"]))


@dataclass(frozen=True)
class Limits:
    """Tokens of a chunk: aimed at, at most, repeated from the one before, and under which it joins that."""

    target: int = 650
    most: int = 900
    overlap: int = 80
    least: int = 40


_UNIT = "struct<text:string,code:boolean,language:string,n:int>"
_PIECE = r"((?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])\s*)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _unit(text: Column, code: Column, language: Column) -> Column:
    return F.struct(text.alias("text"), code.alias("code"), language.cast("string").alias("language"), token_count(text).cast("int").alias("n"))


def _pieces(text: Column) -> Column:
    """Tokens with the blanks after them."""
    return F.regexp_extract_all(strip(text), F.lit(_PIECE), F.lit(1))


def cut(text: Column, size: Column | int) -> Column:
    """Pieces of at most ``size`` tokens, with what stands between the tokens."""
    size = (F.lit(size) if isinstance(size, int) else size).cast("int")
    return _let(_pieces(text), lambda p: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: strip(F.array_join(F.slice(p, i * size + 1, size), "")))))


def tail(text: Column, size: int) -> Column:
    """The last ``size`` tokens, with what stands between them."""
    return _let(_pieces(text), lambda p: strip(F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - size + 1), F.lit(size)), "")))


def markdown_blocks(text: Column) -> Column:
    """Units (text, code, language, n): fences are whole, an open one runs to the end; prose splits at blank lines."""
    strings = F.array().cast("array<string>")

    def closed(acc: Column) -> Column:
        return _let(strip(F.array_join(acc["prose"], "\n")), lambda body: F.when(body == "", acc["done"]).otherwise(F.array_append(acc["done"], _unit(body, F.lit(False), F.lit(None)))))

    def fenced(done: Column, lines: Column, language: Column) -> Column:
        return F.array_append(done, _unit(F.array_join(lines, "\n"), F.lit(True), language))

    def state(done: Column, prose: Column, code: Column, mark: Column, language: Column) -> Column:
        return F.struct(done.alias("done"), prose.alias("prose"), code.alias("code"), mark.cast("string").alias("mark"), language.cast("string").alias("language"))

    def step(acc: Column, line: Column) -> Column:
        none, opened = F.lit(None), acc["mark"].isNotNull()
        mark, language = F.regexp_extract(line, "^\\s*(`{3,})", 1), F.lower(F.regexp_extract(line, r"^\s*`{3,}\s*([\w+#.-]*)\s*$", 1))
        return (
            F.when(opened & (strip(line) == acc["mark"]), state(fenced(acc["done"], F.array_append(acc["code"], line), acc["language"]), acc["prose"], strings, none, none))
            .when(opened, state(acc["done"], acc["prose"], F.array_append(acc["code"], line), acc["mark"], acc["language"]))
            .when(line.rlike(r"^\s*`{3,}\s*[\w+#.-]*\s*$"), state(closed(acc), strings, F.array(line), mark, F.nullif(language, F.lit(""))))
            .when(strip(line) == "", state(closed(acc), strings, strings, none, none))
            .otherwise(state(acc["done"], F.array_append(acc["prose"], line), strings, none, none))
        )

    start = state(F.array().cast(f"array<{_UNIT}>"), strings, strings, F.lit(None), F.lit(None))
    end = lambda acc: F.when(acc["mark"].isNotNull(), fenced(acc["done"], acc["code"], acc["language"])).otherwise(closed(acc))
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, end)


def split_code(block: Column, language: Column, size: int) -> Column:
    """Parts of a fenced block in fences of their own, by lines and, within a long line, by tokens."""
    strings = F.array().cast("array<string>")
    mark = F.regexp_extract(block, r"^\s*(`+)", 1)
    head = F.concat(mark, F.coalesce(language, F.lit("")))
    lines = F.split(block, "\n")
    ends = ((F.size(lines) > 1) & (strip(F.element_at(lines, -1)) == mark)).cast("int")
    room = F.greatest(F.lit(1), size - token_count(head) - token_count(mark)).cast("int")
    render = lambda now: F.concat_ws("\n", head, F.array_join(now, "\n"), mark)

    def parts(least: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            n = token_count(piece).cast("int")
            full = (acc["used"] + n > least) & (F.size(acc["now"]) > 0)
            return F.struct(
                F.when(full, F.array_append(acc["done"], render(acc["now"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, F.array(piece)).otherwise(F.array_append(acc["now"], piece)).alias("now"), F.when(full, n).otherwise(acc["used"] + n).alias("used"),
            )

        pieces = F.flatten(F.transform(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1 - ends)), lambda x: F.when(token_count(x) <= least, F.array(x)).otherwise(cut(x, least))))
        start = F.struct(strings.alias("done"), strings.alias("now"), F.lit(0).alias("used"))
        return F.aggregate(pieces, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], render(acc["now"]))).otherwise(acc["done"]))

    return _let(room, parts)


def chunks(text: Column, limits: Limits = Limits()) -> Column:
    """Chunks (text, code, language, n) of mixed prose and code, in order.

    Fenced code stays whole unless it passes ``most``.  A block that would pass the target closes
    the chunk before it; a chunk of fewer than ``least`` tokens joins the one before it where both
    fit; one without code begins with the last ``overlap`` tokens of the one before.  A chunk's
    language is that of its code, if that is one; joined chunks keep it only if both have it.
    Null and blank texts have none.
    """
    none = F.array().cast(f"array<{_UNIT}>")
    each = lambda texts, u: F.transform(texts, lambda x: _unit(x, u["code"], u["language"]))
    split = lambda u: F.when(u["n"] <= limits.most, F.array(u)).when(u["code"], each(split_code(u["text"], u["language"], limits.most), u)).otherwise(each(cut(u["text"], limits.most), u))
    units = F.flatten(F.transform(markdown_blocks(text), split))

    def joined(now: Column) -> Column:
        languages = F.array_distinct(F.array_compact(F.transform(now, lambda u: u["language"])))
        n = F.aggregate(now, F.lit(0), lambda s, u: s + u["n"])
        return F.struct(F.array_join(F.transform(now, lambda u: u["text"]), "\n\n").alias("text"), F.exists(now, lambda u: u["code"]).alias("code"), F.when(F.size(languages) == 1, F.get(languages, F.lit(0))).alias("language"), n.alias("n"))

    def with_last(out: Column, last: Column, c: Column) -> Column:
        both = F.struct(F.concat_ws("\n\n", last["text"], c["text"]).alias("text"), (last["code"] | c["code"]).alias("code"), F.when(last["language"] == c["language"], c["language"]).alias("language"), (last["n"] + c["n"]).alias("n"))
        return F.array_append(F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1)), both)

    def overlapped(last: Column, c: Column) -> Column:
        def body(before: Column) -> Column:
            n = (token_count(before) + c["n"]).cast("int")
            longer = F.struct(F.concat_ws("\n\n", before, c["text"]).alias("text"), c["code"].alias("code"), c["language"].alias("language"), n.alias("n"))
            return F.when(n <= limits.most, longer).otherwise(c)

        return _let(tail(last["text"], limits.overlap), body) if limits.overlap else c

    def flushed(out: Column, now: Column) -> Column:
        def body(s: Column) -> Column:
            last, c = s["last"], s["c"]
            return (
                F.when(last.isNull(), F.array_append(out, c)).when((c["n"] < limits.least) & (last["n"] + c["n"] <= limits.most), with_last(out, last, c))
                .when(c["code"], F.array_append(out, c)).otherwise(F.array_append(out, overlapped(last, c)))
            )

        return F.when(F.size(now) == 0, out).otherwise(_let(F.struct(F.try_element_at(out, F.lit(-1)).alias("last"), joined(now).alias("c")), body))

    def step(acc: Column, u: Column) -> Column:
        full = (acc["n"] > 0) & (F.size(acc["now"]) > 0) & (acc["n"] + u["n"] > limits.target)
        one = F.struct(F.when(full, flushed(acc["out"], acc["now"])).otherwise(acc["out"]).alias("out"), F.when(full, F.array(u)).otherwise(F.array_append(acc["now"], u)).alias("now"), F.when(full, u["n"]).otherwise(acc["n"] + u["n"]).alias("n"))
        done = lambda s: F.struct(F.when(s["n"] >= limits.target, flushed(s["out"], s["now"])).otherwise(s["out"]).alias("out"), F.when(s["n"] >= limits.target, none).otherwise(s["now"]).alias("now"), F.when(s["n"] >= limits.target, 0).otherwise(s["n"]).alias("n"))
        return _let(one, done)

    start = F.struct(none.alias("out"), none.alias("now"), F.lit(0).alias("n"))
    return F.aggregate(units, start, step, lambda acc: flushed(acc["out"], acc["now"]))


def chunked(docs: DataFrame, key: str, text: Column, limits: Limits = Limits()) -> DataFrame:
    """key, ordinal, text, n_tokens, has_code, language of every chunk."""
    rows = docs.select(key, F.posexplode(chunks(text, limits)).alias("ordinal", "c"))
    return rows.select(key, "ordinal", F.col("c.text").alias("text"), F.col("c.n").alias("n_tokens"), F.col("c.code").alias("has_code"), F.col("c.language").alias("language"))
