"""Segments of texts: cuts before runs of white space that a tokenizer's merges cannot cross.

A pattern that splits words from white space, and a vocabulary in which no entry holds the two
bytes on either side of a cut, treat the segments of a text one by one as they treat the whole.
All of it runs inside Spark tasks, over the UTF-8 bytes of a slice of an Arrow column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from siltstone.llm.textkit import SPACES, slices


def joined_pairs(entries: Iterable[bytes]) -> np.ndarray:
    """256 x 256 flags: which byte and white space byte after it stand together in some entry."""
    out = np.zeros((256, 256), bool)
    for entry in entries:
        for before, after in zip(entry, entry[1:], strict=False):
            if SPACES[after]:
                out[before, after] = True
    return out


def segment_starts(raw: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The first byte of every segment; each non-empty text begins with one.

    A cut lies between a byte that ends no white space of any script and a white space byte, if
    ``joined`` doesn't hold the two.  Non-ASCII letters that share their first bytes with white
    space are never cut after, which makes segments longer and never wrong.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(SPACES[raw])
    before = raw.take(at - 1, mode="clip")
    fine = (before > 0x20) & (before != 0x7F) & ~joined[before, raw[at]]
    high = np.flatnonzero(fine & (before >= 128))
    one, two, three = before[high], raw.take(at[high] - 2, mode="clip"), raw.take(at[high] - 3, mode="clip")
    fine[high] = ~(
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    )
    cut = np.zeros(len(raw), bool)
    cut[at[fine]] = True
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def string_array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The strings that begin at ``starts`` and end where the next begins, without copies."""
    ends = np.append(starts, len(raw)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of runs of rows with about ``limit`` bytes of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        for first, end, raw, _ in slices(text, limit, 1 << 62):
            ids.append(batch.column("doc_id").slice(first, end - first))
            texts.append(text.slice(first, end - first))
            size += len(raw)
            if size >= limit:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)
