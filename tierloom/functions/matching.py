"""How much of two texts is the same: an exact bound as a column, and the ratio itself for what the bound leaves open.

The ratio is twice the characters in matching blocks over the characters of both texts. Blocks are found longest first, the
earliest of equals, then left and right of it in the same way. Where the second text has 200 characters or more, those
that make up over a hundredth of it only lengthen blocks and begin none.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters that the bound counts one by one; all others are counted together.
COUNTED = " eaoisrntdlumcp"
#: Texts as long as this have characters too frequent to begin a block.
LONG_TEXT = 200
WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def even_spaces(text: Column) -> Column:
    """White space of any kind and length as one space, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def ratio_bound(a: Column, b: Column) -> Column:
    """A number that the ratio of two texts cannot pass, from lengths and counts of characters; 1 for two empty texts."""
    n = lambda x: F.length(x)
    count = lambda x, c: n(x) - n(F.replace(x, F.lit(c), F.lit("")))
    alike, own = F.lit(0), [F.lit(0), F.lit(0)]
    for c in COUNTED:
        ca, cb = count(a, c), count(b, c)
        alike, own = alike + F.least(ca, cb), [own[0] + ca, own[1] + cb]
    alike = alike + F.least(n(a) - own[0], n(b) - own[1])
    return F.when(n(a) + n(b) == 0, 1.0).otherwise(2 * alike / F.greatest(n(a) + n(b), F.lit(1)))


class _Automaton:
    """All substrings of a sequence of symbols, each with the place where it first ends."""

    def __init__(self, symbols):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        last = 0
        for at, symbol in enumerate(symbols):
            last = self._add(last, symbol, at)

    def _state(self, moves: dict, link: int, length: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _add(self, last: int, symbol, at: int) -> int:
        new = self._state({}, 0, self.length[last] + 1, at)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                half = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
                self.link[q] = self.link[new] = half
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = half
                    p = self.link[p]
        return new

    def longest(self, symbols) -> tuple[int, int, int]:
        """(end in ``symbols``, first end in the sequence, length) of the longest common run, the first of equals; ends are exclusive."""
        best, state, size = (0, 0, 0), 0, 0
        for at, symbol in enumerate(symbols, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state, size = self.next[state][symbol], size + 1
            if size > best[2]:
                best = (at, self.first[state] + 1, size)
        return best


def matched(a: str, b: str) -> int:
    """The number of characters in matching blocks."""
    often = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= LONG_TEXT else set()
    # a frequent character equals none in the search
    own = [-1 - j if c in often else c for j, c in enumerate(b)]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        i, j, size = _Automaton(own[j0:j1]).longest(a[i0:i1])
        i, j = i0 + i - size, j0 + j - size
        while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < i1 and j + size < j1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            todo += [(i0, i, j0, j), (i + size, i1, j + size, j1)]
    return total


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * matched(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def exact_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts; null where one is null, so that rows already decided cost nothing."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
