"""Byte-level BPE through per-worker caches.

A text is cut at its isolated spaces (spaces with no other white space beside them). The
pre-tokenizer of the vocabulary never joins text across such a cut, so the ids of a text are the
ids of its units, one after another; a unit is a run without isolated spaces, and all units but a
segment's first carry their space. Most units repeat, and a cache answers them.

Special strings inside texts are the library's default: each is its one special id, and the text
on either side is tokenized by itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken

#: The split pattern of this family of vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_UNITS = 300_000
#: Longer units are not kept, so that a cache has bounded bytes.
CACHED_UNIT_CHARS = 64

_BESIDE = re.compile(r"\s\s")
_ISOLATED = re.compile(r"(?<!\s) (?!\s)")


@lru_cache(2)
def load(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoder and the special strings of a tokenizer file in JSON."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without normalizer and prefix space")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def units_of(segment: str) -> list[str]:
    """The segment without its isolated spaces; each stands before a unit, but for the first."""
    return _ISOLATED.split(segment) if _BESIDE.search(segment) else segment.split(" ")


class Cache(dict):
    """unit (that follows a space) to a value made of its ids; two tiers: fixed and recent."""

    def __init__(self, value: Callable[[str], object], fixed: dict | None = None, most: int = CACHE_UNITS):
        super().__init__(fixed or {})
        self.value, self.fixed, self.most = value, fixed or {}, most + len(fixed or {})

    def __missing__(self, unit: str):
        found = self.value(" " + unit)
        if len(unit) <= CACHED_UNIT_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(self.fixed)
            self[unit] = found
        return found


class Tokenizer:
    """Counts and ids of whole texts; one for each worker and file."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.encoder, self.special = load(path)
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        encode = self.encoder.encode_ordinary
        self._count, self._bytes = (lambda t: len(encode(t))), (lambda t: np.array(encode(t), "<u4").tobytes())
        self.counts, self.ids = Cache(self._count, frequent), Cache(self._bytes)

    def _segments(self, text: str) -> tuple[list[str], list[str]]:
        if self._cut is None or not any(s in text for s in self.special):
            return [text], []
        return self._cut.split(text), self._cut.findall(text)

    def count(self, text: str) -> int:
        segments, specials = self._segments(text)
        total = len(specials)
        for segment in segments:
            first, *rest = units_of(segment)
            total += self._count(first) + sum(map(self.counts.__getitem__, rest))
        return total

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        segments, specials = self._segments(text)
        out = []
        for i, segment in enumerate(segments):
            first, *rest = units_of(segment)
            out.append(self._bytes(first))
            out.extend(map(self.ids.__getitem__, rest))
            if i < len(specials):
                out.append(np.array([self.special[specials[i]]], "<u4").tobytes())
        return b"".join(out)
