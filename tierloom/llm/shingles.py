"""Sets of word shingles as sorted 64-bit hashes, for many texts at once.

A-Z are lower-cased; words are runs without space, tab, newline, vertical tab, form feed or
carriage return. A text's set has the distinct runs of ``WORDS`` words; a text with fewer words has
its whole sequence as the one element; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Texts are hashed together up to about so many bytes and just so many texts; a longer text goes alone.
TOGETHER_BYTES, TOGETHER_TEXTS = 1 << 19, 256

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    value[gap] = 0
    return value, gap


_VALUE, _GAP = _tables()
_PLACE = np.random.default_rng(8).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_together(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * power[: len(data)], dtype=np.uint64)])
        words = mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for j in range(WORDS):
            runs += words[j : len(words) - WORDS + 1 + j] * _PLACE[j]
        runs = mixed(runs)
        word_ends = np.searchsorted(first, ends)
        out, start = [], 0
        for end in word_ends:
            n = end - start
            if n >= WORDS:
                out.append(np.unique(runs[start : end - WORDS + 1]))
            elif n:
                out.append(mixed((words[start:end] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            start = end
    return out


def shingle_sets(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    """The sets of the texts in order, some texts at a time."""
    together, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if together and (size + len(data) > TOGETHER_BYTES or len(together) == TOGETHER_TEXTS):
            yield _hash_together(together)
            together, size = [], 0
        together.append(data)
        size += len(data) + 1
    if together:
        yield _hash_together(together)
