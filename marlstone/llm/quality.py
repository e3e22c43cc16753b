"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

``statistics`` turns each whole text into a few bounded numbers.  ``fit``
standardises them over the labelled rows, so texts are read once, maps them to ``FEATURES`` random cosines
(which approximate a Gaussian kernel), sums the normal equations per
partition and fold, solves the ridge systems on the driver (their size is fixed by
``FEATURES``) and calibrates the raw scores with a monotone step function.  That is fitted to
counts per raw-score bin, each row scored by the model of the other folds.  All labelled rows that are not held out take part.

Defined results: a null or empty text has the statistics of zero words, and a text of any length is one row of statistics of all of it; null
labels or ids teach nothing; a doc_id labelled twice, or labelled rows that are repeated, count as often as they come; without labels of both classes every score is the
smoothed share of label 1; a score equal to the threshold is label 1; an empty table gives no rows; ``with_statistics`` keeps
doc_id alone, so no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 256
#: Kernel width on standardised statistics and ridge weight per row, picked of 15 combinations by five folds of rows that are not
#: held out (README); calibration bins over raw scores in [-1, 2].
WIDTH = 10.0
RIDGE = 1e-5
BINS = 600
#: Parts of the labelled rows, by hash of doc_id: the scores of each are calibrated as a model fitted on the others gives them.
FOLDS = 5
SEED = 17

_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"#*$%&|<>")] = 1
_CLASS[list(b"!?")] = 2
_CLASS[list(b".,;:")] = 3
_CLASS[list(b"0123456789")] = 4
_CLASS[list(range(65, 91))] = 5
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 6
STATISTICS = ("log_words", "word_bytes", "word_spread", "symbols", "exclaims", "stops", "digits", "upper", "repeats", "variety", "line_words", "dup_lines")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text."""
    words = common.PackedWords(texts)
    n = np.maximum(words.count, 1).astype(float)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.text_end, prepend=0))
    kinds = np.bincount(owner * 7 + _CLASS[words.buf], minlength=7 * len(texts)).reshape(-1, 7)[:, 1:]
    size = np.maximum(kinds.sum(axis=1), 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, length, len(texts)) / n
    spread = np.sqrt(np.maximum(np.bincount(words.doc, length**2, len(texts)) / n - mean**2, 0))
    h = words.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((h, words.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order][new], minlength=len(texts))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([max(1, len(x)) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines])
    columns = [np.log1p(words.count), np.minimum(mean, 30), np.minimum(spread, 30), *(kinds[:, :5] / size[:, None]).T, np.bincount(words.doc[same], minlength=len(texts)) / n, np.minimum(distinct / n**0.8, 2), np.log1p(words.count / n_lines), dup / n_lines]
    return np.stack(columns, axis=1)


def _of(texts: pa.Array) -> np.ndarray:
    parts = [statistics(run) for _, run in common.text_slices(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    #: Calibrated score of each raw-score bin, not decreasing.
    steps: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """The random features, then the intercept's 1."""
        turn, phase = _projection()
        z = np.clip((stats - self.center) / self.spread, -6, 6)
        out = np.ones((len(stats), FEATURES + 1))
        out[:, :-1] = np.cos(z @ turn + phase) * np.sqrt(2 / FEATURES)
        return out

    def bins(self, stats: np.ndarray) -> np.ndarray:
        raw = self.cosines(stats) @ self.weight
        return np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The bin's step; within a step the raw score breaks ties by less than 1e-6."""
        at = self.bins(stats)
        return np.clip(self.steps[at] * (1 - 1e-6) + 1e-6 * at / BINS, 0, 1)


def isotonic(total: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins with counts; bins without rows take the step below (or above) them."""
    blocks: list[list[float]] = []  # hits, rows, bins
    for k in range(len(total)):
        blocks.append([float(hits[k]), float(total[k]), 1])
        while len(blocks) > 1 and (blocks[-2][1] == 0 or (blocks[-1][1] and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1])):
            hit, rows, bins = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hit, blocks[-1][1] + rows, blocks[-1][2] + bins]
    out, value = [], 0.0
    for hit, rows, bins in blocks:
        value = hit / rows if rows else value
        out += [value] * int(bins)
    return np.array(out)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``stats`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            stats = _of(batch.column("text"))
            offsets = np.arange(len(stats) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "stats": pa.ListArray.from_arrays(pa.array(offsets), pa.array(stats.ravel()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


#: Numbers of a summed vector that travel together.
SLICE = 4096


def _summed(train: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum a vector of fixed size over all rows: each partition that has rows sends its sum in slices, and tasks stream the sums of a slice."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in common.rows_of(batches):
            found = per_batch(_stacked(batch.column("stats")), batch.column("label").to_numpy(), batch.column("fold").to_numpy())
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(0, size, SLICE), "value": [total[k : k + SLICE].tobytes() for k in range(0, size, SLICE)]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in common.rows_of(batches):
            for own, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if own != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"at": [at], "value": [total.tobytes()]})
                    at, total = own, 0.0
                total = total + np.frombuffer(value)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"at": [at], "value": [total.tobytes()]})

    ddl = "at long, value binary"
    sums = train.mapInArrow(partial, ddl).repartition("at").sortWithinPartitions("at").mapInArrow(merged, ddl).toArrow()
    out = np.zeros(size)
    for at, value in zip(sums.column("at").to_pylist(), sums.column("value").to_pylist(), strict=True):
        out[at : at + SLICE] = np.frombuffer(value)
    return out


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """rows: of ``with_statistics``."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).where(F.col("__y").isin(0, 1))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    train = rows.where(~common.is_held_out("doc_id")).join(known, F.col("doc_id") == F.col("__id")).select("stats", F.col("__y").alias("label"), fold.alias("fold"))
    k, m = len(STATISTICS), FEATURES + 1
    total = _summed(train, lambda x, y, _: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(y), y.sum()]]), 2 * k + 2)
    n, ones = total[-2:]
    center = total[:k] / max(n, 1)
    spread = np.sqrt(np.maximum(total[k : 2 * k] / max(n, 1) - center**2, 0)) + 1e-3
    blank = Model(center, spread, np.zeros(m), np.full(BINS, (ones + 1) / (n + 2)))
    if not ones or ones == n:
        return blank
    balance = np.array([n / (2 * (n - ones)), n / (2 * ones)])

    def equations(x, y, fold):
        out = np.zeros((FOLDS, m * m + m + 1))
        f = blank.cosines(x)
        g = f * balance[y][:, None]
        for own in np.unique(fold):
            at = fold == own
            out[own] = np.concatenate([(g[at].T @ f[at]).ravel(), g[at].T @ y[at].astype(float), [at.sum()]])
        return out.ravel()

    sums = _summed(train, equations, FOLDS * (m * m + m + 1)).reshape(FOLDS, -1)

    def solved(of: np.ndarray) -> Model:
        ridge = np.eye(m) * RIDGE * max(of[-1], 1)
        ridge[-1, -1] = 1e-9 * max(of[-1], 1)
        return Model(center, spread, np.linalg.solve(of[: m * m].reshape(m, m) + ridge, of[m * m : -1]), blank.steps)

    # the raw scores that are calibrated are those of models that have not seen the row's fold
    others = [solved(sums.sum(axis=0) - own) for own in sums]

    def counts(x, y, fold):
        out = np.zeros(2 * BINS)
        for own in np.unique(fold):
            at = others[own].bins(x[fold == own])
            out += np.bincount(np.concatenate([at, at[y[fold == own] == 1] + BINS]), minlength=2 * BINS)
        return out

    held = _summed(train, counts, 2 * BINS)
    return Model(center, spread, solved(sums.sum(axis=0)).weight, isotonic(held[:BINS], held[BINS:]))


def score(stats: Column, model: Model) -> Column:
    """Calibrated probability of label 1, a double from 0 to 1 on each row."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_stacked(column)), pa.float64())

    return scored(stats)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = common.materialize(with_statistics(common.read(spark, sf_dir, "documents")), "statistics")
    model = fit(rows, common.read(spark, sf_dir, "labels"))
    scored = rows.select("doc_id", common.is_held_out("doc_id").alias("held_out"), score(F.col("stats"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
