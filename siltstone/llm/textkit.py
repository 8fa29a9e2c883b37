"""Vectorised words, hashes and shingles over the UTF-8 bytes of an Arrow text column.

All of it runs inside Spark tasks, a bounded slice of an Arrow batch at a time, and makes no
Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTES = np.arange(256)
#: Words are runs of bytes other than \x20 and \x09-\x0D.
SPACES = (_BYTES == 0x20) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Words are runs of ASCII letters and digits and of non-ASCII bytes.
NOT_ALNUM = ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128))
#: A-Z to a-z, all else unchanged.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_GAP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0xD6E8FEB86659FD93 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``rows`` rows of about ``limit`` bytes; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column), row + rows)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1].astype(np.int64) - offsets[row]
        row = end


def hash_runs(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """A hash of the byte values of each group; group is sorted, and an empty group has the hash of 0."""
    size = np.bincount(group, minlength=n_groups)
    first = np.cumsum(size) - size
    place = np.arange(len(values)) - first[group]
    powers = np.cumprod(np.full(int(size.max(initial=1)), _BASE, np.uint64))
    total = np.zeros(n_groups, np.uint64)
    if len(values):
        full = np.flatnonzero(size)
        total[full] = np.add.reduceat(_BYTE_KEY[values] * powers[place], first[full])
    return mix(total)


class Words:
    """The words of a slice: ``doc`` (row), ``start``, ``end`` (bytes) and ``hash`` of each, in text order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray | None = LOWER):
        data = raw if fold is None else fold[raw]
        self.data, self.n_docs = data, len(offsets) - 1
        inside = ~separators[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[firsts] = inside[firsts]
        self.start = np.flatnonzero(opens)
        at = np.flatnonzero(inside)
        word = np.cumsum(opens)[at] - 1
        size = np.bincount(word, minlength=len(self.start)) if len(at) else np.zeros(0, np.int64)
        self.end = self.start + size
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.at, self.word = at, word
        self.hash = hash_runs(data[at], word, len(self.start))

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and each document's bounds in them.

        With ``short``, a document of 1 to k-1 words has its whole sequence as one shingle.
        """
        n = len(self.hash)
        counts = np.diff(self.bounds)
        per_doc = np.maximum(counts - k + 1, 0)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                total += self.hash[j : n - k + 1 + j] * _GAP[j]
            total = mix(total)[self.doc[: n - k + 1] == self.doc[k - 1 :]]
        else:
            total = np.zeros(0, np.uint64)
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
            whole = []
            for d in few:
                h = self.hash[self.bounds[d] : self.bounds[d + 1]]
                whole.append(mix((h * _GAP[: len(h)]).sum(dtype=np.uint64, keepdims=True), len(h))[0])
            total = np.insert(total, bounds[few], np.array(whole, np.uint64))
            per_doc[few] = 1
            bounds = np.concatenate([[0], np.cumsum(per_doc)])
        return total, bounds


def name(column: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def nested(df: DataFrame, *replaced: str) -> Column:
    """The columns of df as one struct ``row``, so that no name of theirs clashes with a step's own; without those named."""
    out = {r.lower() for r in replaced}
    return F.struct(*(name(c) for c in df.columns if c.lower() not in out)).alias("row")


def beside(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns nested in ``row``, and then others."""
    kept = [f.name for f in df.schema["row"].dataType.fields]
    return df.select(*(F.col("row")[f].alias(f) for f in kept), *columns)
