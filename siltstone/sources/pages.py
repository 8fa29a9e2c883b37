"""Paged JSON APIs as a Spark data source, batch and stream.

``url`` holds one or more templates with ``{page}``, separated by white space; each is a chain of
pages, read from its first page until one has no items or says that no more follow.  http(s) pages
are fetched with retries, waits that the server asks for and a reserve of its quota; any other
address (file, hdfs, s3, gs) is opened as a saved page, a folder standing for the one file in it.

In a batch each chain is one task.  As a stream an offset is the next page and item of each chain,
so a page that grows is read on from where it ended.  Pages are spooled into a shared folder when a
trigger plans them, and tasks read the spool: a batch that is run again sees the pages as they were.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.sources.files import names

SCHEMA = "chain int, page int, item int, body string"
FORMAT = "siltstone_pages"
#: Server errors and throttling are worth another attempt.
RETRYABLE = frozenset({429, 500, 502, 503, 504})
LONGEST_WAIT = 60.0
#: Saved items are dealt to chains of about so many pages, so that the batches of a stream do not grow in number with the items.
CHAIN_PAGES = 50


class PageError(RuntimeError):
    """A page that cannot be had, by its code."""


class QuotaLow(PageError):
    """The server's quota is down to the reserve; reading goes on from here another time."""


@dataclass(frozen=True)
class Options:
    urls: tuple[str, ...]
    start_page: int = 1
    max_pages: int = 1000
    pages_per_batch: int = 10
    retries: int = 4
    wait: float = 1.0
    quota_reserve: int = 0
    spool: str = ""

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        number = lambda name, kind=int: {name: kind(given[name])} if name in given else {}
        out = cls(tuple(given.get("url", "").split()), **number("start_page"), **number("max_pages"), **number("pages_per_batch"), **number("retries"), **number("wait", float), **number("quota_reserve"), spool=given.get("spool", ""))
        if not out.urls or not all("{page}" in u for u in out.urls) or out.start_page < 1 or out.max_pages < 1 or out.pages_per_batch < 1:
            raise ValueError("url needs templates with {page}; start_page, max_pages and pages_per_batch start at 1")
        return out


def fetch(url: str, options: Options) -> dict:
    """The envelope of one page: items, has_more and what the server says of quota and waits.

    A saved page that isn't there is an empty one.
    """
    if urlsplit(url).scheme not in ("http", "https"):
        return json.loads(_saved(url) or "{}")
    for attempt in range(options.retries + 1):
        after = 0.0
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                envelope = json.load(answer)
            if envelope.get("error_id") not in RETRYABLE:
                break
            code = envelope["error_id"]
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE:
                raise PageError(f"HTTP {e.code}") from e
            code, after = e.code, _seconds(e.headers.get("Retry-After"))
        except (urllib.error.URLError, TimeoutError) as e:
            code = type(e).__name__
        if attempt == options.retries:
            raise PageError(f"gave up after {attempt + 1} attempts: {code}")
        time.sleep(min(max(after, options.wait * 2**attempt), LONGEST_WAIT))
    if envelope.get("error_id"):
        raise PageError(f"error {envelope['error_id']}")
    return envelope


def _seconds(value: str | None) -> float:
    return float(value) if value and value.isdigit() else 0.0


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


def _saved(url: str) -> bytes | None:
    files, path = _open(url)
    info = files.get_file_info(path)
    if info.type == fs.FileType.Directory:
        parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
        path = parts[0] if parts else None
    elif info.type != fs.FileType.File:
        path = None
    if path is None:
        return None
    with files.open_input_stream(path) as f:
        return f.read()


def _rest(envelope: dict, options: Options) -> None:
    """Waits as the server asks, and stops at the reserve of its quota."""
    if envelope.get("backoff"):
        time.sleep(min(float(envelope["backoff"]), LONGEST_WAIT))
    left = envelope.get("quota_remaining")
    if left is not None and left <= options.quota_reserve and envelope.get("has_more"):
        raise QuotaLow(f"{left} requests left")


def _rows(chain: int, page: int, items: list, first: int, end: int | None) -> Iterator[tuple]:
    for i, item in enumerate(items[first:end], first):
        yield chain, page, i, json.dumps(item, ensure_ascii=False)


@dataclass
class Chain(InputPartition):
    number: int


class PageReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Chain]:
        return [Chain(i) for i in range(len(self.options.urls))]

    def read(self, partition: Chain) -> Iterator[tuple]:
        o = self.options
        for page in range(o.start_page, o.start_page + o.max_pages):
            envelope = fetch(o.urls[partition.number].replace("{page}", str(page)), o)
            items = envelope.get("items") or []
            yield from _rows(partition.number, page, items, 0, None)
            if not items or not envelope.get("has_more"):
                return
            _rest(envelope, o)


@dataclass
class Span(InputPartition):
    """Pages of a chain, each with its first item and the end of its items."""

    chain: int
    pages: list[tuple[int, int, int]]


class PageStream(DataSourceStreamReader):
    """Offsets are {chain: [next page, next item]}; a page is left behind once it has a successor."""

    def __init__(self, options: Options):
        if not options.spool:
            raise ValueError("a stream needs a spool: a folder that the driver and all executors share")
        self.options = options
        self.files, self.root = _open(options.spool)
        self.known: dict[tuple[int, int], tuple[int, bool]] = {}  # number of items, and whether more follow, of spooled pages
        self.last: dict[int, int] = {}  # the last spooled page of a chain

    def initialOffset(self) -> dict:
        return {str(i): [self.options.start_page, 0] for i in range(len(self.options.urls))}

    def latestOffset(self) -> dict:
        """Where the spool ends, after it has grown by at most pages_per_batch pages a chain."""
        return {str(i): self._extended(i) for i in range(len(self.options.urls))}

    def _extended(self, chain: int) -> list[int]:
        o = self.options
        if chain not in self.last:
            self.last[chain] = max(self._spooled(chain), default=o.start_page)
        page = self.last[chain]
        for _ in range(o.pages_per_batch):
            before = self._told(chain, page)
            if before is not None and before[1]:
                if page + 1 >= o.start_page + o.max_pages:
                    break
                page, before = page + 1, None
            try:
                envelope = fetch(o.urls[chain].replace("{page}", str(page)), o)
                self._keep(chain, page, envelope)
                _rest(envelope, o)
            except QuotaLow:
                break
            if not envelope.get("items") or not envelope.get("has_more"):
                break
        held = self._told(chain, page)
        return [page, held[0] if held else 0]

    def _path(self, chain: int, page: int) -> str:
        return f"{self.root}/{chain}/{page:09d}.json"

    def _spooled(self, chain: int) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{chain}", allow_not_found=True))
        return [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")]

    def _items(self, chain: int, page: int) -> dict | None:
        data = _saved_in(self.files, self._path(chain, page))
        return None if data is None else json.loads(data)

    def _told(self, chain: int, page: int) -> tuple[int, bool] | None:
        """The number of a spooled page's items and whether more follow; read once."""
        if (chain, page) not in self.known and (held := self._items(chain, page)) is not None:
            self.known[chain, page] = len(held["items"]), held["has_more"]
        return self.known.get((chain, page))

    def _keep(self, chain: int, page: int, envelope: dict) -> None:
        """Spools a page; one that was there only ever grows, so that offsets into it stay true."""
        items, old = envelope.get("items") or [], self._items(chain, page)
        if old is not None:
            items = old["items"] + items[len(old["items"]) :]
        more = bool(envelope.get("has_more")) and bool(items)
        self.files.create_dir(f"{self.root}/{chain}")
        new = f"{self._path(chain, page)}.new"
        with self.files.open_output_stream(new) as f:
            f.write(json.dumps({"items": items, "has_more": more}).encode())
        self.files.move(new, self._path(chain, page))
        self.known[chain, page] = len(items), more
        self.last[chain] = page

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """A task a chain; its first page begins and its last ends where the offsets say."""
        out = []
        for chain, (last_page, last_item) in end.items():
            page, item = start.get(chain, [self.options.start_page, 0])
            pages = []
            while (page, item) < (last_page, last_item):
                stop = last_item if page == last_page else self._told(int(chain), page)[0]
                if stop > item:
                    pages.append((page, item, stop))
                page, item = page + 1, 0
            if pages:
                out.append(Span(int(chain), pages))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        for page, first, end in partition.pages:
            yield from _rows(partition.chain, page, self._items(partition.chain, page)["items"], first, end)


def _saved_in(files: fs.FileSystem, path: str) -> bytes | None:
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read()


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(Options.of(self.options))

    def streamReader(self, schema) -> PageStream:
        return PageStream(Options.of(self.options))


def save_pages(items: DataFrame, order: list[str], body: Column, root: str, size: int) -> str:
    """Saves items in order as pages of a server would be, in chains of about CHAIN_PAGES; returns the templates."""
    place = F.monotonically_increasing_id()
    chains = max(1, -(-items.count() // (size * CHAIN_PAGES)))
    ranged = items.select(*order, body.alias("body")).repartitionByRange(chains, *order).sortWithinPartitions(*order, "body")
    ranged = ranged.withColumns({"chain": F.shiftright(place, 33), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}).withColumn("page", F.expr(f"at div {size} + 1"))
    pages = ranged.groupBy("chain", "page").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("items"))  # ``size`` items a page
    more = F.col("page") < F.max("page").over(Window.partitionBy("chain"))
    text = F.concat(F.lit('{"items":['), F.array_join(F.transform("items", lambda i: i["body"]), ","), F.lit('],"has_more":'), more.cast("string"), F.lit("}"))
    pages.select("chain", "page", text.alias("value")).repartition("chain", "page").write.partitionBy("chain", "page").text(root)
    chains = sorted(int(n[6:]) for n in names(items.sparkSession, root) if n.startswith("chain="))
    return " ".join(f"{root}/chain={c}/page={{page}}" for c in chains)


def register(spark: SparkSession) -> str:
    """Makes the source known to a session; returns its format name."""
    spark.dataSource.register(PageSource)
    return FORMAT
