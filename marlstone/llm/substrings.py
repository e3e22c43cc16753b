"""Substring dedup: windows of words that repeat across documents, found by a count-min prefilter and exact grouping.

Pass 1 sketches every window of ``window`` words: each task sends its sketch as
sorted cells (a cell twice if it was hit twice or more), tasks by block of cells merge
them, and what remains is one bit per cell: hit at least twice.  The width follows the
number of words up to ``MAX_BITS`` cells a row, so the broadcast is at most ``2 * 2**MAX_BITS / 8``
bytes (64 MB); a fuller sketch lets more single windows through but loses none.

Pass 2 deals documents into chunks of some MB, many of which may share a partition.  A chunk sends each distinct
window that the sketch thinks repeated once, with its smallest doc_id; Spark deals these rows by hash and sorts them by
hash and doc_id, so a task streams them and holds one row of the open window, however many chunks have it.  It tells
each chunk the windows (96 bits of hash) that start in a smaller doc_id elsewhere: all of them go.  The others go if the
chunk itself has them in a smaller doc_id.  A window in a third of all documents thus costs one row per chunk.

Defined results: null or empty texts have no words and come back empty; fewer words than the window lose
nothing; rows with equal doc_id are one document's parts for the comparison, so they do not
remove each other's words; rows equal in doc_id and text share a chunk, so that many thousands of one row make it large; a null
doc_id counts as larger than all others; a text of any length is one document of one chunk and is worked on whole; an empty table gives no
rows; other columns, whatever their names, come along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
#: log2 of the cells of a sketch row: at most, and of the blocks that a row is merged in.
MAX_BITS = 28
BLOCK_BITS = 9
#: Windows that a task gathers before it sends their cells (the more, the closer the sorted cells, and the smaller what is sent), and before
#: it sends answers; bytes of text in a chunk.
FLUSH = 6_000_000
ANSWER_FLUSH = 2_000_000
CHUNK_BYTES = 6 << 20
NULL_ID = np.iinfo(np.int64).max

_U = np.uint64
_OTHER = 0xC2B2AE3D27D4EB4F


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    planes = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in map(np.ascontiguousarray, columns))
    return zstandard.compress(planes, 1)


def unpack(packed: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def window_hashes(words: common.PackedWords, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, 64-bit hash and 32 more bits of each window."""
    h = words.hashes()
    at = words.windows(window)
    return at, common.rolling(h, window, common.BASE)[at], (common.rolling(h, window, _OTHER)[at] >> _U(32)).astype(np.uint32)


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of a hash: by its highest and by its lowest bits."""
    return (h >> _U(64 - bits)).astype(np.uint32), (h & _U((1 << bits) - 1)).astype(np.uint32)


def _sketches(bits: int, window: int):
    edges = np.arange(1 << BLOCK_BITS, dtype=np.uint32) << np.uint32(bits - BLOCK_BITS)

    def sent(gathered: list[np.ndarray]) -> pa.RecordBatch:
        rows, blocks, payloads = [], [], []
        for row, found in enumerate(cells(np.concatenate(gathered), bits)):
            found.sort()
            keep = np.ones(len(found), bool)
            keep[2:] = found[2:] != found[:-2]  # a cell at most twice
            found = found[keep]
            at = np.searchsorted(found, edges)
            for block, (a, b) in enumerate(zip(at, [*at[1:], len(found)], strict=True)):
                if a < b:
                    rows.append(row)
                    blocks.append(block)
                    payloads.append(pack(np.diff(found[a:b], prepend=edges[block])))
        return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32()), "block": pa.array(blocks, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in common.rows_of(batches):
            for _, texts in common.text_slices(batch.column("text")):
                words = common.PackedWords(texts)
                h = common.rolling(words.hashes(), window, common.BASE)[words.windows(window)]
                gathered.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield sent(gathered)
                    gathered, n = [], 0
        if n:
            yield sent(gathered)

    return run


def _merged(bits: int):
    size = 1 << (bits - BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(size, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "twice": pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())})

        for batch in common.rows_of(batches):
            for row, block, payload in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "payload")), strict=True):
                if key != (row, block):
                    if key:
                        yield done()
                    key, counts = (row, block), np.zeros(size, np.uint8)
                (gaps,) = unpack(payload, np.uint32)
                at = np.cumsum(gaps, dtype=np.int64)
                again = np.zeros(len(gaps), bool)
                again[1:] = gaps[1:] == 0
                for part in (at[~again], at[again]):
                    counts[part] = np.minimum(counts[part] + 1, 2)
        if key:
            yield done()

    return run


def sketch(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Two rows of bits, least significant first: the cells that at least two windows hit."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / 4)), 16, MAX_BITS))
    parts = docs.select("text").mapInArrow(_sketches(bits, window), "row int, block int, payload binary")
    whole = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merged(bits), "row int, block int, twice binary").toArrow()
    out = np.zeros((2, 1 << BLOCK_BITS, (1 << (bits - BLOCK_BITS)) // 8), np.uint8)
    for row, block, twice in zip(*(whole.column(c).to_pylist() for c in ("row", "block", "twice")), strict=True):
        out[row, block] = np.frombuffer(twice, np.uint8)
    return out.reshape(2, -1)


def maybe_repeated(h: np.ndarray, twice: np.ndarray) -> np.ndarray:
    bits = int(twice.shape[1] * 8).bit_length() - 1
    ok = np.ones(len(h), bool)
    for row, at in enumerate(cells(h, bits)):
        ok &= (twice[row, at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return ok


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy()


def _candidates(table: pa.Table, id_name: str, twice: np.ndarray, window: int):
    """Of each slice of a chunk: its words, the slice's first row, and of its suspicious windows the first word, hashes and doc_id."""
    ids = _ids(table.column(id_name))
    texts = table.column("text").combine_chunks()
    for row, run in common.text_slices(texts):
        words = common.PackedWords(run)
        at, h, more = window_hashes(words, window)
        ok = maybe_repeated(h, twice)
        at = at[ok]
        yield words, row, at, h[ok], more[ok], ids[row + words.doc[at]]


def _first_of(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and id, and where each distinct hash begins in it."""
    order = np.lexsort((ids, more, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


#: tail: the 32 more bits of the hash, and the chunk above them.
_SENT = "h long, tail long, id long"
_LOW = 0xFFFFFFFF
_ANSWER = pa.schema([("chunk", pa.int32()), ("payload", pa.binary())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT in order of hash and id to (chunk, payload): the windows of each chunk that start in a smaller id elsewhere."""
    h0 = more0 = id0 = None
    gathered, n = [], 0

    def sent() -> pa.RecordBatch:
        chunk, h, more = (np.concatenate(c) for c in zip(*gathered, strict=True))
        order = np.argsort(chunk, kind="stable")
        at = np.append(np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0)), len(order))
        # rows come in order of the hash, and so they stay within a chunk
        payload = [pack(np.diff(h[own].view(_U), prepend=_U(0)), more[own]) for own in (order[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
        return pa.RecordBatch.from_pydict({"chunk": chunk[order][at[:-1]], "payload": payload}, schema=_ANSWER)

    for batch in common.rows_of(batches):
        h, tail, ids = (batch.column(c).to_numpy() for c in ("h", "tail", "id"))
        more, chunk = (tail & _LOW).astype(np.uint32), (tail >> 32).astype(np.int32)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        new[0] = (h[0], more[0]) != (h0, more0)
        if new[0]:
            id0 = ids[0]
        least = np.where(new, ids, id0)[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        h0, more0, id0 = h[-1], more[-1], least[-1]
        gone = ids > least
        gathered.append((chunk[gone], h[gone], more[gone]))
        n += int(gone.sum())
        if n >= ANSWER_FLUSH:
            yield sent()
            gathered, n = [], 0
    if n:
        yield sent()


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the text's kept words joined by one space, and two more at the end: ``__n_words`` before and ``__n_removed``
    (more underscores where docs has these)."""
    id_name, chunk_name, n_words_name, n_removed_name = common.free_names(docs, "__id", "__chunk", "__n_words", "__n_removed")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(docs.sparkSession.sparkContext.defaultParallelism, int(size // CHUNK_BYTES) + 1)
    twice = docs.sparkSession.sparkContext.broadcast(sketch(docs, window))
    columns = docs.columns

    def sent(table: pa.Table) -> pa.Table:
        parts = [x[3:] for x in _candidates(table, id_name, twice.value, window)]
        h, more, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, new = _first_of(h, more, ids)
        pick = order[new]
        return pa.table({"h": h[pick].view(np.int64), "tail": more[pick].astype(np.int64) | table.column(chunk_name)[0].as_py() << 32, "id": ids[pick]})

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        n_words = np.zeros(table.num_rows, np.int64)
        n_removed = np.zeros(table.num_rows, np.int64)
        kept: list[bytes] = []
        if table.num_rows:
            parts = [(np.cumsum(gaps, dtype=_U), more) for gaps, more in (unpack(p, _U, np.uint32) for p in answers.column("payload").to_pylist())]
            slices = list(_candidates(table, id_name, twice.value, window))
            h, more, ids = (np.concatenate(c) for c in zip(*(s[3:] for s in slices), strict=True))
            # what starts in a smaller id elsewhere counts as one more row of this chunk, before all others
            told = [np.concatenate([x, *c]) for x, c in zip((h, more), zip(*parts, strict=True) if parts else ((), ()))]
            order, new = _first_of(*told, np.append(ids, np.full(len(told[0]) - len(ids), np.iinfo(np.int64).min)))
            ids = np.append(ids, np.full(len(told[0]) - len(ids), np.iinfo(np.int64).min))
            gone = np.zeros(len(ids), bool)
            gone[order] = ids[order] > ids[order][new][np.cumsum(new) - 1] if len(ids) else False
            begin = 0
            for words, row, at, *_ in slices:
                starts = at[gone[begin : begin + len(at)]]
                begin += len(at)
                step = np.zeros(len(words.doc) + 1, np.int64)
                step[starts] += 1
                step[starts + window] -= 1
                keep = np.cumsum(step[:-1]) == 0
                n_words[row : row + len(words.count)] = words.count
                n_removed[row : row + len(words.count)] = np.bincount(words.doc[~keep], minlength=len(words.count))
                kept += words.joined(keep)
        out = {c: table.column(c) for c in columns} | {"text": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out | {n_words_name: n_words, n_removed_name: n_removed})

    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    rows = docs.select("*", F.col("doc_id").cast("long").alias(id_name), chunk.alias(chunk_name)).repartition(chunk_name)
    dealt = rows.groupBy(chunk_name).applyInArrow(sent, _SENT).repartition("h").sortWithinPartitions("h", F.col("tail").bitwiseAND(_LOW), "id")
    answers = dealt.mapInArrow(_answers, "chunk int, payload binary").withColumnRenamed("chunk", chunk_name)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(n_words_name, T.LongType()), T.StructField(n_removed_name, T.LongType())])
    return rows.groupBy(chunk_name).cogroup(answers.groupBy(chunk_name)).applyInArrow(removed, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
