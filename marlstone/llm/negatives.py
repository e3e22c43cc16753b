"""Hard negatives by ball-tree branch-and-bound.

Rows are dealt evenly into parts of ``PART_BYTES``, whatever their ids, and each part gets a ball tree.  Anchors are packed into blocks of
``BLOCK`` that stream through every part: a part holds its tree and one block.  For a block and a node the inner product
of each anchor with any row below lies within ``anchor . centre +- |anchor| * radius``, so a node is left out for an anchor if that
range misses the score window on either side, or lies strictly beneath the k-th best score so far (an equal score may
still win by its id), or if the node holds no row of a fitting label.  What is left at the leaves is scored exactly.  Each part
sends its best k for each anchor and window; these are merged by a ranked window.

Round one finds the positives (own label, no score window), round two the negatives (other labels, a window of scores for each positive).

Scores are exact integers; those beyond +-``LARGEST`` count as that.  Defined results: rows with a null id, label or vector, or a null or
non-finite component, take no part; vectors of different lengths are filled up with zeros; rows with one id are never each other's positives or
negatives, else each row counts, also if it repeats another; an anchor that is repeated with equal label and vector is one anchor;
an anchor without positives, or whose windows hold nothing, gives no row; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of vectors in a part, anchors in a block, rows in a leaf.
PART_BYTES = 16 << 20
BLOCK = 256
LEAF = 128
LARGEST = (2**63 - 1) // 100
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in floats where these can hold them."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64).reshape(len(a), len(b))


class BallTree:
    """Rows of a part, in order of their ids within each node, with balls around them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.points = self.vectors.astype(float)
        self.nodes: list[tuple] = []  # centre, radius, least and greatest label, children or rows
        self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius = float(away.max()) * (1 + 1e-9)
        at, labels = len(self.nodes), self.labels[rows]
        self.nodes.append(())
        if len(rows) <= LEAF or not radius:
            below = rows
        else:
            one = own[np.argmax(away)]
            other = own[np.argmax(((own - one) ** 2).sum(axis=1))]
            near = np.zeros(len(rows), bool)
            near[np.argpartition(own @ (other - one), len(rows) // 2)[: len(rows) // 2]] = True
            below = (self._grow(rows[near]), self._grow(rows[~near]))
        self.nodes[at] = (centre, radius, int(labels.min()), int(labels.max()), below)
        return at

    def best(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (anchors x windows x k) of the first k rows of each score window, NONE where there are fewer.

        same: rows of the anchor's label, else of any other.
        """
        points = vectors.astype(float)
        norm = np.sqrt((points**2).sum(axis=1))
        score, found = np.full((*low.shape, k), NONE), np.full((*low.shape, k), NO_ID)
        stack = [(0, np.arange(len(ids)))]
        while stack:
            node, act = stack.pop()
            centre, radius, least, most, below = self.nodes[node]
            middle = points[act] @ centre
            # rounding: of the products, and of scores that are clipped
            slack = norm[act] * radius + 1e-9 * norm[act] * (np.sqrt(centre @ centre) + radius) + 1
            up, down = np.minimum(middle + slack, LARGEST)[:, None], np.maximum(middle - slack, -LARGEST)[:, None]
            fits = (labels[act] >= least) & (labels[act] <= most) if same else (labels[act] != least) | (labels[act] != most)
            need = fits[:, None] & (up >= low[act]) & (down <= high[act]) & (up >= score[act, :, k - 1])
            open_ = need.any(axis=1)
            act, need = act[open_], need[open_]
            if not len(act):
                continue
            if isinstance(below, tuple):
                toward = [float((points[act] @ self.nodes[c][0]).mean()) for c in below]
                stack += [(c, act) for _, c in sorted(zip(toward, below, strict=True))]  # the more promising one comes off first
                continue
            s = dots(vectors[act], self.vectors[below])
            ok = ((labels[act][:, None] == self.labels[below]) == same) & (ids[act][:, None] != self.ids[below])
            for w in range(low.shape[1]):
                inside = ok & need[:, w : w + 1] & (s >= low[act, w : w + 1]) & (s <= high[act, w : w + 1])
                held = np.where(inside, s, NONE)
                top = held.max(axis=1)
                rows = np.flatnonzero((top > NONE) & (top >= score[act, w, k - 1]))
                if len(rows):
                    self._merge(score, found, act[rows], w, held[rows], self.ids[below])
        return score, found

    @staticmethod
    def _merge(score: np.ndarray, found: np.ndarray, act: np.ndarray, w: int, held: np.ndarray, ids: np.ndarray) -> None:
        k, at = score.shape[2], np.arange(len(act))
        s, i = [score[act, w]], [found[act, w]]
        for _ in range(min(k, held.shape[1])):  # rows of a leaf are in order of ids, and argmax takes the first
            first = held.argmax(axis=1)
            top = held[at, first]
            s.append(top[:, None])
            i.append(np.where(top > NONE, ids[first], NO_ID)[:, None])
            held[at, first] = NONE
        s, i = np.concatenate(s, axis=1), np.concatenate(i, axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]
        score[act, w], found[act, w] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


_BLOCK = "part int, kind int, seq long, anchors array<long>, ids array<long>, labels array<long>, vectors array<long>, low array<long>, high array<long>"
_BEST = "anchor long, anchor_id long, window int, id long, score long"


def _longs(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    held = batch.column(column)
    ends, values = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _blocks(dim: int):
    """Anchors (row, id, label, vector, low, high) to blocks of them, in rows of _BLOCK."""

    def packed(rows: list[tuple], seq: int) -> pa.RecordBatch:
        anchor, ids, labels, vectors, low, high = zip(*rows, strict=True)
        flat = [np.concatenate([np.pad(v, (0, dim - len(v))) for v in vectors]), np.concatenate(low), np.concatenate(high)]
        lists = [[np.array(x, np.int64)] for x in (anchor, ids, labels)] + [[x] for x in flat]
        arrays = [pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([seq], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]
        return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "seq", "anchors", "ids", "labels", "vectors", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in common.rows_of(batches):
            scalars = [batch.column(c).to_pylist() for c in ("row", "id", "label")]
            held += zip(*scalars, *[_longs(batch, c) for c in ("vector", "low", "high")], strict=True)
            while len(held) >= BLOCK:
                yield packed(held[:BLOCK], held[0][0])
                held = held[BLOCK:]
        if held:
            yield packed(held, held[0][0])

    return run


def _search(dim: int, k: int, same: bool):
    """Sorted rows of _BLOCK (of each part its rows, then the blocks of anchors) to rows of _BEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, tree = None, [], None
        for batch in common.rows_of(batches):
            names = ("anchors", "ids", "labels", "vectors", "low", "high")
            for here, kind, *lists in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), *[_longs(batch, c) for c in names], strict=True):
                anchors, ids, labels, vectors, low, high = lists
                if here != part:
                    part, rows, tree = here, [], None
                if kind == 0:
                    rows.append((int(ids[0]), int(labels[0]), np.pad(vectors, (0, dim - len(vectors)))))
                    continue
                if rows and tree is None:
                    own = list(zip(*rows, strict=True))
                    tree = BallTree(np.array(own[0], np.int64), np.array(own[1], np.int64), np.stack(own[2]))
                    rows = []
                if tree is None:
                    continue
                n = len(ids)
                score, found = tree.best(ids, labels, vectors.reshape(n, dim), low.reshape(n, -1), high.reshape(n, -1), k, same)
                a, w, place = np.nonzero(score > NONE)
                yield pa.RecordBatch.from_pydict({"anchor": anchors[a], "anchor_id": ids[a], "window": w.astype(np.int32), "id": found[a, w, place], "score": score[a, w, place]})

    return run


def _best(rows: DataFrame, anchors: DataFrame, parts: int, dim: int, k: int, same: bool, name: str) -> DataFrame:
    """anchor, anchor_id, window, id, score and rank of the first k rows of each anchor and window."""
    blocks = common.materialize(anchors.mapInArrow(_blocks(dim), _BLOCK), f"{name}-blocks")
    everywhere = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    none = F.array().cast("array<long>")
    single = rows.select("part", F.lit(0).alias("kind"), F.col("row").alias("seq"), none.alias("anchors"), F.array("id").alias("ids"), F.array("label").alias("labels"), F.col("vector").alias("vectors"), none.alias("low"), none.alias("high"))
    dealt = single.unionByName(everywhere).repartition(parts, "part").sortWithinPartitions("part", "kind", "seq")
    found = dealt.mapInArrow(_search(dim, k, same), _BEST)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return common.materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


def integer_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label and vector (each component times scale, rounded down) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = table.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    return whole.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: id, label, vector (integers).

    An anchor's positives are the first rows of its label by score, its hard negatives for a positive the first rows of other labels that
    score low to high percent of what the positive scores.
    """
    numbered = common.materialize(rows.select("id", "label", "vector", F.monotonically_increasing_id().alias("row")), "vectors")
    n, dim = numbered.agg(F.count("*"), F.max(F.size("vector"))).first()
    dim = max(dim or 0, 1)
    parts = max(min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAF), n * dim * 8 // PART_BYTES) + 1
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    one = numbered.where(is_anchor).groupBy("id", "label", "vector").agg(F.min("row").alias("row"))
    any_score = [F.array(F.lit(x)).alias(c) for c, x in (("low", -LARGEST), ("high", LARGEST))]
    found = _best(dealt, one.select("row", "id", "label", "vector", *any_score), parts, dim, positives, True, "positives")
    percent = lambda p: F.expr(f"({p} * score - pmod({p} * score, 100)) div 100")  # noqa: E731  of the score, rounded down
    edges = found.select("anchor", F.struct("rank", (-percent(-low)).alias("low"), percent(high).alias("high")).alias("edge"))
    windows = edges.groupBy("anchor").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # an anchor has as many windows as any other: those that lack a positive let no score in
    full = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("edges"), i)[c], F.lit(x))).alias(c)
    asked = one.join(windows, one["row"] == windows["anchor"]).select("row", "id", "label", "vector", full("low", 1), full("high", 0))
    hard = _best(dealt, asked, parts, dim, negatives, False, "negatives")
    own = found.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(own, ["anchor", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = integer_rows(common.read(spark, sf_dir, "embeddings"))
    turned = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(turned, F.col("id") % 50 == 0)
