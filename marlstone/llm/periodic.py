"""Periodic runs of words, by branching tandem repeats of a suffix tree (Stoye and Gusfield).

A *run* is a stretch of words with smallest period q that no neighbouring word extends; those of ``min_exponent`` periods and
``min_length`` words count.  A run of four periods or more has its period's words at four places at least, so only tree nodes with that many leaves matter:

1. Prefix doubling groups the suffixes of each text by their first 1, 2, 4, ... words; a group of fewer suffixes than ``LEAVES`` is not refined.
   Texts are taken together up to ``SLICE_WORDS`` words, and no group reaches beyond one text.
2. Ranks of all lengths give the common prefixes of neighbouring suffixes, and one pass over these gives the inner nodes.
3. At each node all leaves but those of its largest child are tried (the smaller halves, n log n leaves in all): leaf i at a node of depth d
   starts a tandem repeat if leaf i + d is below the node too, and a branching one if the word behind it differs from its first.
4. A branching tandem repeat ends its run.  It is rotated to the left word by word as far as words d apart agree, which merges all repeats of the
   run; of repeats that give one stretch the smallest period is kept.

Words are compared as such, not by hashes.  One text is worked on whole in one task: memory follows its length (some 60 bytes a word and 4
for each doubling).

Defined results: null or empty texts have no words and no runs; a text of any length counts whole; repeated rows and null ids are rows like
any other; an empty table gives no rows; all columns of docs come along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Least leaves of a node that is looked at, so the least exponent that can be asked for.
LEAVES = 4
#: Words that are looked at together; a longer text is looked at alone.
SLICE_WORDS = 200_000

WORD_GAP = r"[\x20\x09-\x0D]+"


def groups_by_prefix(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in an order in which those of a common prefix stand together, and ranks by the first 1, 2, 4, ... words.

    ids: word numbers, no number in two texts; end: where each word's text ends.  Places of the order that nobody may look at are -1.
    """
    n = len(ids)
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids]  # where the group begins in the order
    order = np.full(n, -1, np.int64)
    at = np.flatnonzero(count[ids] >= LEAVES)
    at = at[np.argsort(rank[at], kind="stable")]
    slot = np.sort(rank[at]) + _place(rank[at])
    order[slot] = at
    levels, h = [rank.astype(np.int32)], 1
    while len(at):
        after = at + h
        then = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + then)
        at, then = at[by], then[by]
        order[slot] = at
        old = rank[at]
        new = np.ones(len(at), bool)
        new[1:] = (old[1:] != old[:-1]) | (then[1:] != then[:-1])
        begin = slot[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        rank = rank.copy()
        rank[at] = np.repeat(begin, size)
        levels.append(rank.astype(np.int32))
        more = np.repeat(size >= LEAVES, size)
        at, slot, h = at[more], slot[more], 2 * h
    return order, levels


def _place(sorted_groups: np.ndarray) -> np.ndarray:
    """Place of each value within its group of equal neighbours."""
    start = np.flatnonzero(np.append(True, sorted_groups[1:] != sorted_groups[:-1])) if len(sorted_groups) else np.empty(0, np.int64)
    return np.arange(len(sorted_groups)) - np.repeat(start, np.diff(np.append(start, len(sorted_groups))))


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix of the order shares with the one before it; 0 at the edges of groups."""
    lcp = np.zeros(len(order), np.int64)
    held = order >= 0
    slot = np.flatnonzero(held[1:] & held[:-1]) + 1
    x, y = order[slot - 1], order[slot]
    same = levels[0][x] == levels[0][y]
    slot, x, y = slot[same], x[same], y[same]
    length, stop = np.zeros(len(slot), np.int64), end[np.maximum(x, y)]
    last = np.maximum(x, y)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(last + length < stop)
        grow = inside[levels[k][x[inside] + length[inside]] == levels[k][y[inside] + length[inside]]]
        length[grow] += 1 << k
    lcp[slot] = length
    return lcp


def inner_nodes(lcp: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(depth, first and last place, first and last place of the largest child) of the nodes with LEAVES leaves or more."""
    found = []
    stack: list[list[int]] = []  # depth, first place, largest child so far
    top = 0
    for r, d in enumerate([*lcp[1:], 0]):
        first = r  # the child that ends at r: a leaf, or the node that was closed last
        while top > d:
            node = stack.pop()
            if r - first > node[3] - node[2]:
                node[2], node[3] = first, r
            first = node[1]
            if r - first + 1 >= LEAVES:
                found.append((top, first, r, node[2], node[3]))
            top = stack[-1][0] if stack else 0
        if d > top:
            stack.append([d, first, first, r])
            top = d
        elif d and r - first > stack[-1][3] - stack[-1][2]:
            stack[-1][2], stack[-1][3] = first, r
    return found


def branching_repeats(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and period of the tandem repeats whose next word is not their first."""
    order, levels = groups_by_prefix(ids, end)
    held = np.flatnonzero(order >= 0)
    lcp = common_prefixes(order, levels, end)
    nodes = np.array(inner_nodes(lcp[held].tolist()), np.int64).reshape(-1, 5)
    order = order[held]
    place = np.full(len(ids), -1, np.int64)
    place[order] = np.arange(len(order))
    depth, low, high, big_low, big_high = nodes.T
    owner = np.repeat(np.arange(len(nodes)), (high - low) - (big_high - big_low))
    leaf = low[owner] + _place(owner)
    leaf = np.where(leaf >= big_low[owner], leaf + (big_high - big_low + 1)[owner], leaf)
    i, d, low, high = order[leaf], depth[owner], low[owner], high[owner]
    n = len(ids)
    found = []
    for first in (i, i - d):  # the leaf begins the repeat, or its second half
        second = first + d
        other = np.where(first == i, second, first)
        inside = (first >= begin[i]) & (second < end[i])
        at = place[np.clip(other, 0, n - 1)]
        tandem = np.flatnonzero(inside & (at >= low) & (at <= high))
        first, period = first[tandem], d[tandem]
        behind = first + 2 * period
        branching = (behind >= end[first]) | (ids[first] != ids[np.minimum(behind, n - 1)])
        found.append((first[branching], period[branching]))
    first, period = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(first * (n + 1) + period, return_index=True)
    return first[once], period[once]


def _rotations(ids: np.ndarray, begin: int, first: int, period: int) -> int:
    """How many words a tandem repeat can be moved to the left."""
    moved, step = 0, 64
    while True:
        size = min(step, first - moved - begin)
        if size <= 0:
            return moved
        at = first - moved
        differ = np.flatnonzero(ids[at - size : at] != ids[at - size + period : at + period])
        if len(differ):
            return moved + size - 1 - int(differ[-1])
        moved, step = moved + size, 2 * step


def runs_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(first word, length, period) of the runs in texts that stand one behind the other, sorted."""
    if min_exponent < LEAVES:
        raise ValueError(f"min_exponent must be {LEAVES} or more")
    if not len(ids):
        return []
    first, period = branching_repeats(ids, begin, end)
    for back in (1, 2):  # a run of four periods lets its last repeat rotate twice at least
        ok = first - back >= begin[first]
        ok[ok] = ids[first[ok] - back] == ids[first[ok] + period[ok] - back]
        first, period = first[ok], period[ok]
    last = first + 2 * period
    by = np.lexsort((period, last))
    found: dict[tuple[int, int], int] = {}
    ended: list[tuple[int, int]] = []  # start and period of the stretches of smaller periods that end at the same word
    before = -1
    for f, q, e in zip(first[by].tolist(), period[by].tolist(), last[by].tolist(), strict=True):
        ended, before = ended if e == before else [], e
        if any(f >= start and q % smaller == 0 for start, smaller in ended):
            continue  # several periods of a run that is known
        start = f - _rotations(ids, int(begin[f]), f, q)
        ended.append((start, q))
        if e - start >= max(min_length, min_exponent * q):
            found.setdefault((start, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_by_text(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    numbers: list[int] = []
    sizes, base = np.fromiter(map(len, texts), np.int64, len(texts)), 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, base + len(own)) for w in words]
        base += len(own)
    stop = np.cumsum(sizes)
    begin, end = np.repeat(stop - sizes, sizes), np.repeat(stop, sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    for start, length, period in runs_of(np.array(numbers, np.int64), begin, end, min_length, min_exponent):
        out[owner[start]].append((start - int(begin[start]), length, period))
    return out


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    run, size = [], 0
    for raw in texts:
        words = (raw or b"").split()  # bytes: exactly the white space that WORD_GAP lists
        if run and size + len(words) > SLICE_WORDS:
            yield run
            run, size = [], 0
        run.append(words)
        size += len(words)
    if run:
        yield run


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))


_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, runs: str = "runs", kept: str = "collapsed", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs, all columns, and two more: the runs (start, length, period) of the text by start and period, and the text without repeats.

    The names of the two get underscores in front where docs has such columns.
    """
    runs, kept = common.free_names(docs, runs, kept)
    columns = docs.columns
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            found, texts = [], []
            for part in _slices(batch.column("text").cast(pa.binary()).to_pylist()):
                for words, own in zip(part, runs_by_text(part, min_length, min_exponent), strict=True):
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    texts.append(collapsed(words, own))
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, arrow), pa.array(texts, pa.binary()).cast(pa.string())], [*columns, runs, kept])

    schema = T.StructType([*docs.schema.fields, T.StructField(runs, _RUNS), T.StructField(kept, T.StringType())])
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: the smallest start, then period.  Null where there is none."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    def best(column: pa.Array) -> pa.Array:
        out = [min(own, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if own else None for own in column.to_pylist()]
        return pa.array(out, pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    return best(runs)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; the texts that crc32(doc_id) picks repeat a stretch of their own words from some word on to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", WORD_GAP, -1), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(F.col("g"), n)
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    return rows.select("doc_id", F.when(F.col("words").isNotNull() & (n > 0), F.concat_ws(" ", turned)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_period(common.read(spark, sf_dir, "documents")))
    rows = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
