"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (3 to 7 code points, A-Z lower-cased,
white space collapsed to one space, a space at either end) of the whole text,
hashed into ``BUCKETS`` buckets.  ``fit``

1. counts, over *all* labelled rows, in how many texts of each class a bucket
   occurs (summed per partition, then by bucket) and takes the smoothed
   log-ratio of the two class frequencies,
2. keeps the buckets that tell the classes apart: those of enough texts (at most ``MIN_TEXTS``, fewer if a class
   has few texts) whose ratio is at least ``MIN_RATIO`` either way; rare n-grams only serve to learn texts by heart,
3. fits logistic weights, both classes weighing the same, on presence x ratio over a bounded sample of labelled
   rows: at most ``sample_per_class`` of each class, those of the smallest hash of doc_id.

``score`` is map-only.  Defined results: a null or empty text scores as a text
without n-grams (the intercept), a text of any length by all of its n-grams; labels that are null or whose doc_id is null or
absent teach nothing; a doc_id labelled twice, or with several rows, counts as often in the ratios; without a row of
either class every score is the smoothed share of toxic labels; a score equal to the threshold is toxic; an empty table gives
no rows; ``drop_toxic`` returns the columns of docs, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: These, MIN_TEXTS, MIN_RATIO and PENALTY are the best of 40 combinations by five folds of rows that are not held out (README).
ORDERS = (3, 4, 5, 6, 7)
#: Bound of the sample that the logistic weights are fitted on, per class.
SAMPLE_PER_CLASS = 1000
SMOOTHING = 1.0
#: A feature needs so many texts, or a thirtieth of the smaller class if that is less, and so large a ratio.
MIN_TEXTS = 10
MIN_RATIO = 1.5
PENALTY = 1e-4
ROUNDS = 150

_U = np.uint64


@dataclass(frozen=True)
class Model:
    """The buckets that are features, and the weight (ratio times logistic weight) of each; a text scores sigmoid(intercept + sum / sqrt(n))."""

    buckets: np.ndarray
    weight: np.ndarray
    intercept: float


def _normal(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace").lower()  # bytes: only A-Z
    return np.frombuffer(b" ".join([b"", *raw.split(), b""]).decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def _occurrences(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, repeats included."""
    points = _normal(text).astype(_U)
    found = [common.rolling(points + _U(n), n, common.BASE) >> _U(64 - BUCKET_BITS) for n in ORDERS if len(points) >= n]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def ngram_buckets(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's n-grams.  seen: scratch of BUCKETS int64, any content."""
    ids = _occurrences(text)
    at = np.arange(len(ids))
    seen[ids] = at  # of equal buckets the last stays
    return ids[seen[ids] == at]


def _slots(buckets: np.ndarray) -> np.ndarray:
    """Place of each bucket among the features, -1 for the others."""
    slot = np.full(BUCKETS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    return slot


def _features(text: str | None, slot: np.ndarray) -> np.ndarray:
    """The features that a text holds, each once."""
    at = slot[_occurrences(text)]
    return np.unique(at[at >= 0])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros((2, BUCKETS), np.int64), [0, 0]
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, ngram_buckets(text, seen)] += 1
            n[toxic] += 1
    hit = np.flatnonzero(counts.any(axis=0))
    bucket = np.append(hit, -1)  # -1: the number of texts
    yield pa.RecordBatch.from_pydict({"bucket": bucket, "clean": np.append(counts[0, hit], n[0]), "toxic": np.append(counts[1, hit], n[1])})


def _fit_weights(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised logistic loss, half of which is each class's."""
    size = np.array([len(r) for r in rows])
    ids = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    w, b = np.zeros(len(ratio)), 0.0
    mw, vw, mb, vb = w.copy(), w.copy(), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(doc, (w * ratio)[ids], len(rows)) * scale + b
        slope = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        gw = np.bincount(ids, (slope * scale)[doc], len(ratio)) * ratio + PENALTY * w
        gb = slope.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        step = 0.1 / (1 - 0.9**t)
        fix = np.sqrt(1 - 0.99**t)
        w -= step * mw / (np.sqrt(vw) / fix + 1e-8)
        b -= step * mb / (np.sqrt(vb) / fix + 1e-8)
    return w * ratio, float(b)


def _tilted(sums: DataFrame, n0: int, n1: int) -> pd.DataFrame:
    """bucket, ratio of the buckets that are features: at most BUCKETS rows."""
    least = float(np.clip(min(n0, n1) / 30, 1, MIN_TEXTS))
    rate = lambda c, n: F.log((F.col(c) + SMOOTHING) / (n + 2 * SMOOTHING))
    rows = sums.where((F.col("bucket") >= 0) & (F.col("clean") + F.col("toxic") >= least)).select("bucket", (rate("toxic", n1) - rate("clean", n0)).alias("ratio"))
    return rows.where(F.abs("ratio") >= MIN_RATIO).toPandas().sort_values("bucket")


def _sample(docs: DataFrame, known: DataFrame, slot: np.ndarray, most: int) -> DataFrame:
    """toxic, rank, features of at most ``most`` labelled rows of each class; texts are read for the rows picked only."""
    rank = F.xxhash64(F.col("__id")).alias("rank")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            found = [_features(t, slot).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "rank": batch.column("rank"), "features": pa.array(found, pa.binary())})

    ids = docs.select(F.col("doc_id").alias("__id")).where(~common.is_held_out("__id")).join(common.narrow_side(known.distinct()), "__id").select("__id", "__y", rank)
    picked = [ids.where(F.col("__y") == label).orderBy("rank").limit(most).distinct() for label in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionAll(picked[1])), F.col("doc_id") == F.col("__id")).select("text", F.col("__y").alias("toxic"), "rank")
    found = rows.mapInArrow(held, "toxic int, rank long, features binary")
    # a doc_id of many rows can bring more than were picked
    return found.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy("rank"))).where(F.col("n") <= most).drop("n")


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from the labelled rows that are not held out; only model parameters reach the driver."""
    docs = common.small_batches(docs)
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).where(F.col("__y").isin(0, 1))
    train = docs.select("doc_id", "text").where(~common.is_held_out("doc_id")).join(common.narrow_side(known), F.col("doc_id") == F.col("__id")).select("text", F.col("__y").alias("toxic"))
    sums = common.materialize(train.mapInArrow(_class_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "buckets")
    n = sums.where("bucket = -1").first()
    n0, n1 = (n.clean, n.toxic) if n else (0, 0)
    none = np.empty(0)
    if not n0 or not n1:
        return Model(none.astype(np.int64), none, float(np.log((n1 + 1) / (n0 + 1))))
    tilted = _tilted(sums, n0, n1)
    buckets, ratio = tilted["bucket"].to_numpy(np.int64), tilted["ratio"].to_numpy(float)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toxic", "rank"], kind="stable")
        weight, intercept = _fit_weights([np.frombuffer(f, "<i4") for f in pdf.features], pdf.toxic.to_numpy(), ratio)
        return pd.DataFrame({"weight": [weight.tobytes()], "intercept": [intercept]})

    sample = _sample(docs, known, _slots(buckets), sample_per_class)
    row = sample.groupBy().applyInPandas(fitted, "weight binary, intercept double").first()
    return Model(buckets, np.frombuffer(row.weight, float), row.intercept)


def score(text: Column, model: Model) -> Column:
    """Probability that the text is toxic, a double from 0 to 1 on each row."""
    buckets, weight, intercept = model.buckets, model.weight, model.intercept

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slot = _slots(buckets)
        for texts in batches:
            z = np.full(len(texts), intercept)
            for i, t in enumerate(texts):
                held = _features(t, slot)
                if len(held):
                    z[i] += weight[held].sum() / np.sqrt(len(held))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return scored(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    model = fit(docs, labels)
    return docs.where(score(F.col("text"), model) < threshold)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", common.is_held_out("doc_id").alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
