"""Helpers that several corpus operators share.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` in the UTF-8
text.  ``PackedWords`` finds the words of many texts at once in one NumPy
buffer and gives each a 64-bit hash, so that no Python object is made per word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers look at together.
SLICE_BYTES = 1 << 19

#: Bytes of rows that Spark sends to Python in one Arrow batch, and at most one row more; see ``small_batches``.
BATCH_BYTES = 1 << 21
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Base of the rolling hashes: odd, so that it can be divided by.
BASE = 0x9E3779B97F4A7C15

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the run folder and read it back: lineage ends in files that outlive executors."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the application's intermediate tables.  For the caller, once nothing is left to be computed from them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, of a session that from now on sends BATCH_BYTES to Python at once, unless it has a bound of its own.

    Spark's own bounds, 64 MB and 10,000 rows, take in nearly all texts of a task, which the JVM then holds off heap and the worker as bytes and as strings.
    """
    conf = df.sparkSession.conf
    if _BATCH_KEY not in conf.getAll:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


#: Most rows of a table that is sent to every executor (two numbers a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def narrow_side(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if a count shows that it is small; df has numbers only."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of df's columns, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes (null as empty), each with the row it starts at."""
    start, size, run = 0, 0, []
    for row, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
        raw = raw or b""
        if run and size + len(raw) > limit:
            yield start, run
            start, size, run = row, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (multiply and xor-shift rounds)."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    filled, step = 1, _U(base & (2**64 - 1))
    while filled < n:  # powers [k, 2k) are powers [0, k) times base**k
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled, step = filled + more, step * step
    return out


class _Tables:
    """Byte values and powers of the rolling hash; grown on demand, once per worker."""

    def __init__(self):
        self.byte = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
        self.power = self.back = np.empty(0, _U)

    def upto(self, n: int):
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power, self.back = _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)
        return self.power[:n], self.back[:n]


_tables: _Tables | None = None


def segment_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
    global _tables
    _tables = _tables or _Tables()
    power, back = _tables.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(_tables.byte[buf] * power[:-1], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(_U))


class PackedWords:
    """The words of some texts: ``start``/``end`` offsets into ``buf``, the text ``doc`` of each and ``count`` per text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(sizes)
        solid = ~_SPACE[self.buf]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        before = np.searchsorted(self.start, self.text_end)
        self.count = np.diff(before, prepend=0)
        self.first = before - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        return segment_hashes(self.buf, self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """Index of the first word of each window of ``size`` words within one text."""
        if len(self.doc) < size:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :])

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Each text's kept words joined by one space."""
        out = self.buf.copy()
        out[self.end] = 0x20  # every word is followed by a white-space byte
        step = np.zeros(len(out) + 1, np.int8)
        step[self.start[keep]] = 1
        step[self.end[keep] + 1] -= 1
        flat = out[np.cumsum(step[:-1]) > 0].tobytes()
        size = np.bincount(self.doc[keep], (self.end - self.start)[keep] + 1, len(self.texts)).astype(np.int64)
        stop = np.cumsum(size)
        return [flat[b - n : max(b - 1, b - n)] for n, b in zip(size, stop)]


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` values, at the run's first index."""
    n = max(0, len(values) - size + 1)
    total = values[:n].copy()
    for k in range(1, size):
        total *= _U(base)
        total += values[k : n + k]
    return mix(total)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows carry nothing to work on."""
    return (b for b in batches if b.num_rows)
