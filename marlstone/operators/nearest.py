"""Many query vectors against all vectors: blocks of queries stream through parts of the vectors, and each part sends its best few.

Vectors are dealt evenly into parts of some MB, whatever their ids.  Queries are packed into matrices that every part reads one after the other: a task holds
one part and one block.  Of a block's products only the first k of each query leave the task, so what is shuffled is k rows per query and part, and
no table of all (query, vector) pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks

#: Bytes of vectors in a part (as doubles), queries in a block, decimals that scores are compared by.
PART_BYTES = 16 << 20
BLOCK = 256
DECIMALS = 6

_ROW = "part int, kind int, ids array<long>, flat array<double>"
_FOUND = "query_id long, node_id long, score double"


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _packed(dim: int):
    """Queries (query_id, embedding) to matrices of at most BLOCK rows."""

    def block(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(rows)], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "ids", "flat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column("query_id").to_pylist()
            rows += _lists(batch.column("embedding"))
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], rows[:BLOCK])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if ids:
            yield block(ids, rows)

    return run


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, equal ones by id; ids are sorted."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        rows, cols = np.nonzero(scores >= kth[:, None])  # more than k where the k-th score is shared
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    begin = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - begin < k
    return rows[kept], cols[kept]


def _search(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, rows, matrix = None, [], [], None
        for batch in batches:
            for here, kind, own, flat in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), _lists(batch.column("ids")), _lists(batch.column("flat")), strict=True):
                if here != part:
                    part, ids, rows, matrix = here, [], [], None
                if kind == 0:
                    ids.append(own[0])
                    rows.append(flat)
                    continue
                if matrix is None and rows:
                    known = np.array(ids, np.int64)
                    order = np.argsort(known, kind="stable")
                    known, matrix, rows = known[order], _unit(np.stack(rows))[order].T, []
                if matrix is None:
                    continue
                scores = np.round(_unit(flat.reshape(len(own), dim)) @ matrix, DECIMALS) + 0.0
                r, c = first_of(scores, known, k)
                yield pa.RecordBatch.from_pydict({"query_id": own[r], "node_id": known[c], "score": scores[r, c]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, node_id, score (cosine, to DECIMALS) and rank of the k nearest vectors (node_id, embedding) of each query (query_id, embedding).

    Ties go by node_id.  Vectors and queries that are null, hold a null, or are not as long as the longest query take no part; a vector of zeros
    scores 0.  An empty table on either side gives no rows.
    """
    clean = lambda rows, key: rows.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(F.forall("embedding", lambda x: x.isNotNull()) & (F.size("embedding") > 0))
    vectors, queries = clean(vectors, "node_id"), clean(queries, "query_id")
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    sized = lambda rows: rows.where(F.size("embedding") == dim)
    n = sized(vectors).count()
    parts = max(min(vectors.sparkSession.sparkContext.defaultParallelism, n // BLOCK), n * dim * 8 // PART_BYTES) + 1
    rows = sized(vectors).select(F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.array("node_id").alias("ids"), F.col("embedding").alias("flat"))
    blocks = sinks.kept(sized(queries).mapInArrow(_packed(dim), _ROW), "queries").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.unionByName(blocks.select("part", "kind", "ids", "flat")).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(_search(dim, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
