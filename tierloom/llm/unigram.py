"""Unigram segmentation over a double-array trie of pieces, and its inverse.

Spaces become the marker ``▁`` and one marker is put before the text. Among all ways to cut the
marked text into pieces of the vocabulary, the one with the largest sum of log scores is taken, in
double precision; of equal sums, at every position the longest last piece. A character that no
piece covers costs ``UNKNOWN_PENALTY`` less than the smallest score and is written as its UTF-8
bytes, in byte pieces.

No piece of the vocabulary has a marker after another character, so the best cut of a text is the
best cuts of its units (markers and what follows them), one after another. Units are looked up in a
bounded cache for each worker; all units of a batch that are not there go through the trie and the
Viterbi recursion together, one numpy step for each position and length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 300_000
CACHED_UNIT_CHARS = 64
#: Units go through the recursion together in tables of up to so many cells.
TABLE_CELLS = 1 << 20

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>$")


class DoubleArray:
    """``base`` and ``check``: the child of state s by code c is ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, keys: list[tuple[int, ...]], codes: int):
        """``keys``: distinct nonempty sequences of codes 1..codes; ``value`` at a state is a key's index or -1."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 8 * sum(map(len, keys)) + 8 * codes + 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0], wide = True, 1  # lone children fill gaps, sets of children are sought from ``wide`` on
        after = list(range(size + 1))  # leads to the next free cell

        def next_free(i: int) -> int:
            end = i
            while taken[end]:
                after[end] = max(after[end], end + 1)
                end = after[end]
            while i < end:
                after[i], i = end, after[i]
            return end

        todo = [(0, 0, len(order), 0)]  # state, range of keys below it, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                self.value[state] = order[lo]
                lo += 1
            starts = [i for i in range(lo, hi) if i == lo or keys[order[i]][depth] != keys[order[i - 1]][depth]]
            if not starts:
                continue
            children = np.array([keys[order[i]][depth] for i in starts])
            free, tried = next_free(max(1 if len(children) == 1 else wide, int(children[0]) + 1)), 0
            while len(children) > 1 and taken[free - children[0] + children].any():
                free, tried = next_free(free + 1), tried + 1
            if tried > 32:
                wide = free
            spot = free - int(children[0])
            self.base[state] = spot
            taken[spot + children] = True
            self.check[spot + children] = state
            todo += [(spot + int(c), i, j, depth + 1) for c, i, j in zip(children, starts, [*starts[1:], hi], strict=True)]
        last = int(np.flatnonzero(taken)[-1]) + codes + 1
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none; code 0 is no character of the vocabulary."""
        to = self.base[states] + codes
        return np.where((codes > 0) & (self.check[to] == states), to, -1)


class Unigram:
    """Pieces with log scores; ids are the vocabulary's."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: dict[int, int]):
        """``bytes_at``: byte to id. Entries with an empty piece are no text (control and byte entries)."""
        self.pieces, self.bytes_at = pieces, bytes_at
        real = [i for i, p in enumerate(pieces) if p]
        self.longest = max(len(pieces[i]) for i in real)
        if any(MARK in pieces[i].lstrip(MARK) for i in real):
            raise ValueError("a piece has a marker inside")
        alphabet = sorted({c for i in real for c in pieces[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.trie = DoubleArray([tuple(self.code[[ord(c) for c in pieces[i]]].tolist()) for i in real], len(alphabet))
        self.real, self.scores = np.array(real), np.array([scores[i] for i in real])
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.cache: dict[str, bytes] = {}
        byte_of = {i: bytes([b]) for b, i in bytes_at.items()}
        self.raw = [byte_of.get(i, p.encode()) for i, p in enumerate(pieces)]

    def _best(self, units: list[str]) -> list[bytes]:
        """The ids of each unit; units of like length, all at once."""
        n, lengths = len(units), np.fromiter(map(len, units), np.int64, len(units))
        width = int(lengths.max())
        points = np.zeros((n, width + self.longest), np.int32)
        points[np.arange(width + self.longest) < lengths[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<i4")
        codes = self.code[points]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            states, covered = np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
            open_rows = np.arange(len(rows))
            for size in range(1, self.longest + 1):
                states = self.trie.step(states, codes[rows[open_rows], start + size - 1])
                alive = (states >= 0) & (start + size <= lengths[rows[open_rows]])
                states, open_rows = states[alive], open_rows[alive]
                if not len(states):
                    break
                ends = self.trie.value[states]
                hit = ends >= 0
                at, key = rows[open_rows[hit]], ends[hit]
                if size == 1:
                    covered[open_rows[hit]] = True
                score = best[at, start] + self.scores[key]
                better = score > best[at, start + size]
                at, key = at[better], key[better]
                best[at, start + size], back[at, start + size], piece[at, start + size] = score[better], start, self.real[key]
            bare = rows[~covered]
            score = best[bare, start] + self.unknown
            better = score > best[bare, start + 1]
            bare = bare[better]
            best[bare, start + 1], back[bare, start + 1], piece[bare, start + 1] = score[better], start, -1
        # from the ends backwards, all units at once; a cut's id is -1 for an unknown character
        ids, filled, end, rows = np.zeros((n, width), np.int64), np.zeros(n, np.int64), lengths.copy(), np.arange(n)
        while len(rows):
            ids[rows, width - 1 - filled[rows]] = piece[rows, end[rows]]
            filled[rows] += 1
            end[rows] = back[rows, end[rows]]
            rows = rows[end[rows] > 0]
        flat = ids[np.arange(width) >= width - filled[:, None]]
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum(filled) * 4
        out = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.flatnonzero((ids < 0).any(axis=1)):
            at, whole = 0, []
            for k in ids[i, width - filled[i] :].tolist():
                size = len(self.pieces[k]) if k >= 0 else 1
                whole += [k] if k >= 0 else [self.bytes_at[b] for b in units[i][at : at + 1].encode("utf-8", "surrogatepass")]
                at += size
            out[i] = np.array(whole, "<u4").tobytes()
        return out

    def _learn(self, units: Iterable[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        waiting = sorted(units, key=len)
        while waiting:
            width = len(waiting[0]) * 5 // 4 + 4
            n = max(1, TABLE_CELLS // (width + self.longest))
            group = [u for u in waiting[:n] if len(u) <= width]
            found.update(zip(group, self._best(group), strict=True))
            waiting = waiting[len(group) :]
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; the empty text has none."""
        keys = [_unit_keys(t) for t in texts]
        missing = {_marked(k): k for u in keys for k in u if k not in self.cache}
        self.cache.update((missing[m], ids) for m, ids in self._learn(missing).items())
        out = [b"".join(map(self.cache.__getitem__, u)) for u in keys]
        for k in [k for k in missing.values() if len(k) > CACHED_UNIT_CHARS]:
            del self.cache[k]
        while len(self.cache) > CACHE_UNITS:  # the last come go, so what was frequent from the start stays
            self.cache.popitem()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: markers are spaces, the first one is dropped, byte pieces are UTF-8."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def _unit_keys(text: str) -> list[str]:
    """A key for each unit: the unit without its one marker, or after NUL any other unit as it is."""
    if not text:
        return []
    if "  " not in text and MARK not in text and "\0" not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    units = _UNIT.findall(MARK + text.replace(" ", MARK))
    return [u[1:] if len(u) > 1 and u[0] == MARK and u[1] not in (MARK, "\0") else "\0" + u for u in units]


def _marked(key: str) -> str:
    return key[1:] if key[0] == "\0" else MARK + key


@lru_cache(2)
def load(path: str) -> Unigram:
    """A model file's pieces and scores; one trie for each worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    bytes_at = {int(_BYTE_PIECE.match(model.id_to_piece(i))[1], 16): i for i in ids if model.is_byte(i)}
    text = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    return Unigram([model.id_to_piece(i) if text[i] else "" for i in ids], [model.get_score(i) for i in ids], bytes_at)


def _together(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= 1 << 22:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of every row; null texts count as empty and have no ids.

    Rows without an id and rows that share one are encoded each for itself; whole texts are encoded, however long; other columns are
    not looked at. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            at = 0
            for texts in _together(batch["text"].to_pylist()):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), pa.array(model.encode_batch(texts), pa.binary())], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null and empty ids give the empty text.

    A row without a doc_id, and each of several with one, is decoded for itself, however long; other columns are not looked at. An
    empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([model.decode(x or b"") for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, same_text of every row.

    Every text is encoded and its ids are decoded again. Only a text that has the marker itself
    comes back changed, with a space in its place. A null text is empty: no pieces, and the same text. Repeated rows,
    and rows without an id, are each reported; whole texts are read, however long; other columns are not looked at. An
    empty table gives no rows.
    """
    path = path or public_tokenizers.path(MODEL)
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, same_text boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.bytes_at.values())] = True
        for batch in batches:
            at = 0
            for texts in _together(batch["text"].to_pylist()):
                ids = model.encode_batch(texts)
                back = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(at, len(texts)),
                        "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "n_byte_pieces": pa.array([int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids], pa.int64()),
                        "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                        "same_text": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    }
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
