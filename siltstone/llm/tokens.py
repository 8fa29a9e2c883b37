"""Public tokenizers inside tasks: the driver reads the vocabulary file, the job carries its bytes."""

from __future__ import annotations

import json
import os
from functools import cached_property
from pathlib import Path

import numpy as np


def vocabulary(name: str, path: str | None = None) -> bytes:
    """The file of a public tokenizer: from ``path``, or by name from the installed collection."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_bytes()


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary in JSON; ``plain`` takes the strings of special tokens as ordinary text."""

    def __init__(self, data: bytes, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.data = data
        self.model = Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = plain

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def entries(self) -> list[bytes]:
        """The bytes of each id."""
        letters, spec = byte_letters(), json.loads(self.data)
        words = {i: bytes(letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in letters for c in w)}
        words |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        return [words.get(i, b"") for i in range(max(words) + 1)]


class Pieces:
    """A sentence-piece vocabulary with byte fallback, applied to segments as parts of a longer text.

    A line feed in front, which no piece holds beside its own byte, keeps the added space apart.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.vocab_size()
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.model.id_to_piece(list(range(n))))]
        if any(b"\n" in e and len(e) > 1 for e in self.entries):
            raise ValueError("this vocabulary merges line feeds, so that segments cannot be kept apart")

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment, whose spaces are all its own."""
        return [ids[2:] for ids in self.model.encode(["\n" + s for s in segments], num_threads=1)]

    def keeps(self, character: str) -> bool:
        """Whether the ids of a character spell its own bytes."""
        return b"".join(self.entries[i] for i in self.encode([character])[0]) == character.encode()


def sizes(entries: list[bytes]) -> np.ndarray:
    return np.array([len(e) for e in entries], np.int64)
