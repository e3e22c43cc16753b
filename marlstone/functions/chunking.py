"""Chunks of whole sentences under a token budget, for Han, Latin and mixed text.

A Han or kana character counts as one token, and so does every run of other characters without ASCII white space.  A sentence ends behind a
full-width ender, behind ``. ! ? ;`` (and closing quotes and brackets) before white space, and at a line end; one of more tokens than the budget is cut
into parts of that size.  Chunks are packed greedily; each begins with the last whole sentences of the one before, as many as
fit into the overlap and leave room for the next sentence.  A chunk is a slice of the text, and only white space lies between chunks that do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters that count as one token each.
SINGLE = "⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U000323AF"
CLOSERS = "\"'”’)]》」』）"
SIZE, OVERLAP = 1536, 128
#: Characters of chunks that are sent on together.
FLUSH = 4 << 20

#: (start, end) of tokens, in order: pairs, or an array of two columns.
Spans = Sequence[tuple[int, int]] | np.ndarray


_KINDS = np.zeros(0x110000, np.uint8)  # 1: white space, 2: a token of its own, 0: others
_KINDS[[0x20, *range(9, 14)]] = 1
for _range in re.findall("(.)(?:-(.))?", SINGLE):
    _KINDS[ord(_range[0]) : ord(_range[1] or _range[0]) + 1] = 2
_ENDERS, _SOFT_ENDERS = ([ord(c) for c in x] for x in ("。！？；", ".!?;"))
_CLOSER = np.zeros(0x110000, bool)
_CLOSER[[ord(c) for c in CLOSERS]] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_spans(text: str) -> np.ndarray:
    """A row (start, end) for each token."""
    kind = np.concatenate(([1], _KINDS[_codes(text)], [1]))
    here, before, after = kind[1:-1], kind[:-2], kind[2:]
    first = (here == 2) | (here == 0) & (before != 0)
    last = (here == 2) | (here == 0) & (after != 0)
    return np.column_stack([np.flatnonzero(first), np.flatnonzero(last) + 1])


def sentence_ends(text: str, spans: Spans, size: int) -> list[int]:
    """Behind which tokens sentences end, as numbers of tokens, increasing; no sentence has more tokens than ``size``."""
    if not len(spans):
        return []
    code = _codes(text)
    start, end = np.asarray(spans, np.int64).T
    behind = np.append(start[1:], len(code))
    # the last character that closes nothing; a token of closers only counts with its last one
    open_at = np.maximum.accumulate(np.where(_CLOSER[code], -1, np.arange(len(code))))[end - 1]
    last = code[np.where(open_at >= start, open_at, end - 1)]
    lines = np.append(0, np.cumsum(code == 10))
    ends = np.isin(last, _ENDERS) | np.isin(last, _SOFT_ENDERS) & (behind > end) | (lines[np.maximum(behind, end)] > lines[end])
    ends[-1] = True
    out, begin = [], 0
    for n in (np.flatnonzero(ends) + 1).tolist():
        out += [*range(begin + size, n, size), n]
        begin = n
    return out


def pack(ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First token and end of each chunk."""
    edges = [0, *ends]  # sentence k has tokens edges[k] to edges[k + 1]
    first, last = 0, len(ends)
    while first < last:
        stop = first + 1
        while stop < last and edges[stop + 1] - edges[first] <= size:
            stop += 1
        yield edges[first], edges[stop]
        if stop == last:
            return
        back = stop
        while back - 1 > first and edges[stop] - edges[back - 1] <= overlap and edges[stop + 1] - edges[back - 1] <= size:
            back -= 1
        first = back


def chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, spans: Callable[[str], Spans] = token_spans) -> Iterator[tuple[int, int, int, str]]:
    """(number of the first token, tokens, first character, text) of each chunk."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    found = spans(text or "")
    for a, b in pack(sentence_ends(text or "", found, size), size, overlap):
        first, end = int(found[a][0]), int(found[b - 1][1])
        yield a, b - a, first, text[first:end]


def chunk_rows(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text", spans: Callable[[str], Spans] = token_spans) -> DataFrame:
    """A row for each chunk: the columns of rows, but the chunk for the text, and ``chunk`` (from 0), ``first_token``, ``n_tokens``, ``first_char``.

    ``spans`` gives the (start, end) of the tokens of a text, in order.  Chunks are streamed, so a long text never stands in one row with all of
    them.  A null or blank text has no chunks.  Columns of rows with the names of the new ones get an underscore in front.
    """
    new = ("chunk", "first_token", "n_tokens", "first_char")
    fields = [T.StructField(f"_{f.name}" if f.name.lower() in new else f.name, f.dataType) for f in rows.schema.fields]
    at = [f.name for f in rows.schema.fields].index(text)
    names = [f.name for f in fields]

    def sent(batch: pa.RecordBatch, taken: list[tuple]) -> pa.RecordBatch:
        row, chunk, first, n, char, texts = (list(x) for x in zip(*taken, strict=True))
        columns = [c.take(pa.array(row)) for c in batch.columns]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(chunk, pa.int32()), *[pa.array(x, pa.int64()) for x in (first, n, char)]], [*names, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, held = [], 0
            for row, whole in enumerate(batch.column(at)):
                for k, (first, n, char, part) in enumerate(chunks_of(whole.as_py(), size, overlap, spans)):
                    taken.append((row, k, first, n, char, part))
                    held += len(part)
                    if held >= FLUSH:
                        yield sent(batch, taken)
                        taken, held = [], 0
            if taken:
                yield sent(batch, taken)

    schema = T.StructType([*fields, T.StructField("chunk", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in new[1:]]])
    return rows.mapInArrow(run, schema)
