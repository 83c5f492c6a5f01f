"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (shares of kinds of characters, words, repetition) are standardised and sent
through ``2 * PAIRS`` random Fourier features of a Gaussian kernel. Every task sums its rows'
normal equations, one set for each of ``FOLDS`` folds; the sums have a fixed size whatever the
input. The driver solves the small ridge systems: one on all folds for scoring, and for each fold
one on the others, whose scores of that fold's rows train the calibration. For that, rows are
counted in ``BINS`` bins of score, and pool-adjacent-violators runs on the bins.

All labelled rows of the training part are used; there is no sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.durable import lasting, scratch, written

PAIRS = 96
FOLDS = 4
BINS = 1000
#: Ridge weight for each training row, and width of the kernel in standard deviations.
RIDGE = 1e-3
WIDTH = 4.0
THRESHOLD = 0.3
SEED = 20

NAMES = (
    "log_chars", "log_words", "word_chars", "long_words", "short_words", "distinct_words", "upper", "lower", "digit",
    "space", "newline", "stop_marks", "bars", "symbols", "marks", "non_ascii", "control", "log_lines", "distinct_lines",
    "line_words", "deflated", "ends_marked", "words_marked", "capital_words",
)
FEATURE_SCHEMA = "doc_id long, features array<double>"
#: So many rejected texts, 16 bytes each, are broadcast; more are joined.
BROADCAST_KEYS = 1_000_000
_SYMBOLS, _MARKS = set(b"#$%&*+<=>@\\^_`{}~"), set(b"!?\"'()-/:;[]")


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((256, 10))
    for b in range(256):
        kind = (
            0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in (32, 9) else 4 if b in (10, 13)
            else 5 if b in (44, 46) else 6 if b == 124 else 7 if b in _SYMBOLS else 8 if b in _MARKS else 9
        )
        kinds[b, kind] = 1
    return kinds


_KINDS = _byte_classes()


def text_statistics(text: str) -> list[float]:
    """The statistics in ``NAMES`` of a whole text; all defined for the empty one."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = counts @ _KINDS
    words = text.split()
    lines = text.split("\n")
    k, distinct = max(1, len(words)), set(words)
    letters = max(1.0, kinds[0] + kinds[1])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # words are looked at by their distinct forms, of which there are fewer
    forms = max(1, len(distinct))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, float((lengths > 14).sum()) / k, float((lengths < 3).sum()) / k,
        len(distinct) / k, kinds[0] / letters, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        kinds[8] / n, counts[128:].sum() / n, (counts[:32].sum() - counts[9] - counts[10] - counts[13]) / n, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), len(zlib.compress(data, 1)) / n,
        sum(not x[-1].isalnum() for x in distinct) / forms, sum(not x.isalnum() for x in distinct) / forms, sum(x[0].isupper() for x in distinct) / forms,
    ]


def features(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id and the statistics of every row, and a struct ``key`` if there is one; a null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_statistics(x or "") for x in batch["text"].to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), pa.array(rows.ravel()))
            held = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in held), flat], [*held, "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([] if key is None else [key.alias("key")]), "text")
    return rows.mapInArrow(measure, FEATURE_SCHEMA if key is None else "doc_id long, key struct<k0:bigint,k1:bigint>, features array<double>")


@dataclass
class Model:
    """Small and of fixed size: it is broadcast inside the tasks' closures."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray] | None

    def design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        angle = z @ self.frequencies
        return np.hstack([np.ones((len(z), 1)), z, np.cos(angle), np.sin(angle)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; 0.5 for every text where nothing was learned."""
        if self.weights is None or self.steps is None:
            return np.full(len(rows), 0.5)
        return np.clip(np.interp(self.design(rows) @ self.weights, *self.steps), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def isotonic_steps(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order; each pool's middle and its share of good rows."""
    pools: list[list[float]] = []  # good, n, sum of positions
    for x, g, k in zip(at, good, n, strict=True):
        pools.append([g, k, x * k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from summed normal equations, whose last column is the right side."""
    gram, right = sums[:, :-1], sums[:, -1]
    penalty = np.full(len(gram), RIDGE * max(gram[0, 0], 1.0))
    penalty[0] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


def fit(labelled: DataFrame) -> Model:
    """``labelled``: rows of doc_id, features and label (0 or 1)."""
    rng = np.random.default_rng(SEED)
    frequencies = rng.standard_normal((len(NAMES), PAIRS)) / WIDTH
    labelled = written(labelled, "labelled")
    moments = labelled.select(F.posexplode("features")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r.pos], scale[r.pos] = r.m, max(r.s, 1e-6)
    model = Model(mean, scale, frequencies, None, None)
    if not moments:
        return model
    d = 1 + len(NAMES) + 2 * PAIRS

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            x, y, folds = model.design(_matrix(batch)), batch["label"].to_numpy(), batch["fold"].to_numpy()
            for f in range(FOLDS):
                at = folds == f
                sums[f, :, :-1] += x[at].T @ x[at]
                sums[f, :, -1] += x[at].T @ y[at]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(FOLDS * d), pa.int32()), "sums": pa.array(list(sums.reshape(FOLDS * d, d + 1)), pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        total = table["sums"].combine_chunks().flatten().to_numpy().reshape(-1, d + 1).sum(axis=0)
        return pa.table({"part": table["part"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int"))
    schema = "part int, sums array<double>"
    sums = np.zeros((FOLDS * d, d + 1))
    for r in folded.mapInArrow(normal_equations, schema).groupBy("part").applyInArrow(added, schema).collect():
        sums[r.part] = r.sums
    sums = sums.reshape(FOLDS, d, d + 1)
    model.weights = _solve(sums.sum(axis=0))
    by_fold = [_solve(sums.sum(axis=0) - sums[f]) for f in range(FOLDS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, folds = model.design(_matrix(batch)), batch["fold"].to_numpy()
            raw = np.einsum("ij,ij->i", x, np.array(by_fold)[folds])
            bins = np.floor(np.clip(raw, -0.5, 1.5) * BINS / 2).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "label": batch["label"]})

    bins = folded.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    found = sorted((r.bin, r.good, r.n) for r in bins.collect())
    at, good, n = (np.array(x, dtype=float) for x in zip(*found, strict=True))
    model.steps = isotonic_steps((at + 0.5) * 2 / BINS, good, n)
    return model


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits modulo 5 is 0; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(measured: DataFrame, labels: DataFrame) -> Model:
    """From features and labels(doc_id, quality) of rows that are not held out; null labels are left out."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    wanted = wanted.filter(F.col("label").isNotNull() & ~is_held_out(F.col("doc_id")))
    return fit(measured.join(wanted, "doc_id"))


def score_texts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null texts count as empty and get a score too; whole texts are measured, however long; repeated rows
    get the same score; labels that contradict each other count each. Without any labelled row all scores
    are 0.5; an empty table gives no rows. Only ``labels.quality`` is learned from; other columns are not looked at.
    """
    with scratch(docs.sparkSession):
        measured = written(features(docs), "features")
        model = train(measured, labels)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

        scored = lasting(measured.mapInArrow(score, "doc_id long, score double"), "scores")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all columns, where they lie.

    Nulls, ties, repeated rows and empty tables as in :func:`score_texts`; rows without an id are scored
    by their text like others. Texts are measured once. A score hangs on the text alone, so rows leave by their text's two
    64-bit hashes: up to ``BROADCAST_KEYS`` rejected texts (16 bytes each, counted first) are broadcast, more are joined.
    """
    keys = lambda: [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    with scratch(docs.sparkSession):
        text_key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys())))
        measured = written(features(docs, text_key), "features")
        model = train(measured.select("doc_id", "features"), labels)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = pa.array(model.score(_matrix(batch)) < threshold)
                yield pa.RecordBatch.from_arrays([batch["key"].field(i).filter(bad) for i in (0, 1)], ["__tierloom_k0", "__tierloom_k1"])

        rejected = lasting(measured.select("key", "features").mapInArrow(judge, "__tierloom_k0 long, __tierloom_k1 long").distinct(), "rejected")
    few = rejected.count() <= BROADCAST_KEYS
    same = (keys()[0] == F.col("__tierloom_k0")) & (keys()[1] == F.col("__tierloom_k1"))
    return docs.join(F.broadcast(rejected) if few else rejected, same, "left_anti")
