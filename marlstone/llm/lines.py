"""Line dedup over range-partitioned line hashes, answered with keep bitmaps.

A line (the text split at ``\\n``) has as its key the line without the bytes
``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.  A key of at least ``min_chars`` code points
that ``min_docs`` or more documents hold loses all its lines but those of the largest
doc_id that holds it.

Each such line sends (128-bit hash, doc_id, position), never its text.  The hashes are
dealt by range of (hash, doc_id) and sorted by (hash, doc_id, position), so a frequent
line spreads over as many partitions as it needs.  A task streams its rows and holds
the rows of a few documents at most; only for a hash at the edge of its range does it
send a summary, two rows a task, which settle the few rows that neighbours decide.

Defined results: null or empty texts are one empty line; a text of any length is split whole; a null doc_id counts as smaller than
all others, and all rows of one doc_id are one document; rows equal in doc_id and
text get the same bitmap; an empty table gives no rows; ``dedup`` returns the columns of docs, whatever they are called,
and two of its own behind them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCS = 3
NULL_ID = np.iinfo(np.int64).min
_BLANK = b" \t\n\r\x0b\x0c"
_ROWS = "h1 long, h2 long, doc long, key long, pos int"
_FOUND = "kind int, h1 long, h2 long, doc long, key long, pos int, n_docs long"
DROP, EDGE, SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            digests, counts, places = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                n = len(digests)
                for pos, line in enumerate((raw or b"").split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            places.append(pos)
                counts.append(len(digests) - n)
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            own = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_pydict({"h1": halves[:, 0], "h2": halves[:, 1], "doc": batch.column("doc").to_numpy()[own], "key": batch.column("key").to_numpy()[own], "pos": np.array(places, np.int32)})

    return run


def _streamed(min_docs: int):
    """Rows sorted by (hash, doc, pos) to rows of _FOUND."""

    def table(kind: int, rows: np.ndarray, n_docs: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": np.full(len(rows), kind, np.int32), "h1": rows["h1"], "h2": rows["h2"], "doc": rows["doc"], "key": rows["key"], "pos": rows["pos"], "n_docs": np.full(len(rows), n_docs)})

    kind = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_docs, first = np.empty(0, kind), 0, True  # rows of the open hash that are undecided, its documents that are decided
        for batch in common.rows_of(batches):
            rows = np.empty(batch.num_rows, kind)
            for c in kind.names:
                rows[c] = batch.column(c).to_numpy()
            rows = np.concatenate([held, rows])
            new = np.ones(len(rows), bool)
            new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
            new_doc = new.copy()
            new_doc[1:] |= rows["doc"][1:] != rows["doc"][:-1]
            group = np.cumsum(new) - 1
            docs = np.bincount(group[new_doc])
            docs[0] += held_docs
            last_row = np.append(np.flatnonzero(new)[1:], len(rows)) - 1
            gone = (docs[group] >= min_docs) & (rows["doc"] != rows["doc"][last_row][group])
            if gone.any():
                yield table(DROP, rows[gone])
            final = len(docs) - 1
            if first and final:  # the first hash has ended: the range before may hold more of it
                yield from edge(rows[(group == 0) & ~gone], docs[0])
                first = False
            held = rows[(group == final) & ~gone]
            # documents of the open hash whose rows are decided are only counted
            held_docs = docs[final] - len(np.unique(held["doc"]))
        if len(held):
            yield from edge(held, held_docs + len(np.unique(held["doc"])))

    def edge(rows: np.ndarray, n_docs: int):
        yield table(EDGE, rows)
        yield table(SUMMARY, rows[-1:], n_docs)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc (doc_id, null as the smallest), key (hash of the text) and pos of each line that goes."""
    rows = common.small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    # written once: dealing by range reads them twice
    hashes = common.materialize(rows.mapInArrow(_line_hashes(min_chars), _ROWS), "hashes")
    # no count given: the session's number of shuffle partitions, which adaptive execution may merge
    dealt = hashes.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    found = common.materialize(dealt.mapInArrow(_streamed(min_docs), _FOUND), "lines")
    whole = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("last"))
    # at most two summaries a task of the range partitioning
    edges = found.where(F.col("kind") == EDGE).join(common.narrow_side(whole), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") < F.col("last")))
    return found.where(F.col("kind") == DROP).select("doc", "key", "pos").unionByName(edges.select("doc", "key", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, key, n_dropped and keep: a compressed bitmap over the lines, least significant bit first, of documents that lose lines.

    Lines behind the bitmap's end are kept.
    """

    @F.arrow_udf("binary")
    def packed(places: pa.Array) -> pa.Array:
        out = []
        for p in places.to_pylist():
            bits = np.ones(max(p) // 8 * 8 + 8, bool)
            bits[p] = False
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        return pa.array(out, pa.binary())

    places = dropped_lines(docs, min_chars, min_docs).groupBy("doc", "key").agg(F.collect_set("pos").alias("places"))
    return places.select("doc", "key", F.size("places").cast("long").alias("n_dropped"), packed("places").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined by \\n; a null bitmap keeps all."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        out = []
        for raw, bitmap in zip(texts.cast(pa.binary()).to_pylist(), bitmaps.to_pylist(), strict=True):
            if bitmap is not None and raw is not None:
                lines = raw.split(b"\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)].tolist()
                raw = b"\n".join([x for x, bit in zip(lines, bits) if bit] + lines[len(bits) :])
            out.append(raw or b"")
        return pa.array(out, pa.binary()).cast(pa.string())

    return kept(text, keep)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, all columns, with the text's kept lines, and two more at the end: ``__n_lines`` before and ``__n_dropped`` (more underscores where docs has these)."""
    n_lines_name, n_dropped_name = common.free_names(docs, "__n_lines", "__n_dropped")
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep"))
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == maps["__doc"]) & (F.xxhash64(docs["text"]) == maps["__key"])
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(maps, match, "left")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [kept_text(docs["text"], maps["__keep"]).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*columns, n_lines.alias(n_lines_name), F.coalesce(maps["__n_dropped"], F.lit(0).cast("long")).alias(n_dropped_name))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
