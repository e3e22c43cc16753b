"""Benchmark decontamination by templates: numbers, units and names become typed slots.

A word's core is the word without ASCII punctuation at its ends, A-Z lower-cased.  A core that
begins with a digit is a number slot; a core of ``UNITS`` behind a number is a unit slot;
a word whose core begins with a capital letter is a name slot; the rest are literal.  Windows of
``window`` template tokens with at least half of them literal are hashed and joined with those
of the benchmark; where the window of either side has fewer, the cores themselves are joined.  The windows of a document that match one item at one
offset must fill its slots consistently: each benchmark value by the same document value,
the one that most windows have (then the smallest), and two names never by one name, while
numbers and units may fall together.  Windows that hold another filling do not count.
A document leaks an item if the other windows cover at least ``min_share`` of the item's windows,
so a copy is caught and so is the same question with other numbers or names; the share is that of the
literal windows found by templates or, where that is too small, that of all windows found either way.

Documents look their hashes up in the sorted benchmark hashes, which are sent to executors only up to
``PROBE_WINDOWS``; for a larger benchmark all windows are shuffled to the join.

Defined results: null or empty texts leak nothing; null or wordless items are ignored; an item of fewer words than the window is one
window, but if it has too little text for a match to mean anything (``LONE_WORDS``, ``LONE_CHARS``: ``yes`` or ``in 1990``), it is
not searched for and ``too_short`` lists it; items of equal text count as the one of the smallest item_id; rows equal in doc_id
and text give one row of results and stay or go together; texts of any length are searched whole; empty tables leak nothing;
``drop_leaks`` returns the columns of docs, whatever they are called.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_SHARE = 0.5
#: 8 bytes each: at most 32 MB are broadcast.
PROBE_WINDOWS = 4_000_000
#: An item of fewer words than the window needs so many words, and letters and digits in them; one of fewer words needs twice the letters.
LONE_WORDS, LONE_CHARS = 3, 12
#: The words that are units when they follow a number.
UNITS = "kg g mg lb oz t km m cm mm mi ft in yd l ml gal s sec seconds min minutes h hr hours days weeks months years meters metres miles feet inches pounds dollars euros cents percent degrees liters litres grams kilograms kilometers kilometres".split()

_U = np.uint64
_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_CORE = _DIGIT | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
LITERAL, NUMBER, UNIT, NAME = range(4)
_SLOT = common.mix(np.arange(1, 5, dtype=_U))
#: Ways that a window is found: by its template; by its words, if the document's is not literal enough; by its words, if the item's is not.
TEMPLATE, DOC_WORDS, ITEM_WORDS = range(3)
_WAY = common.mix(np.arange(5, 8, dtype=_U))
_WAY[TEMPLATE] = 0


class Templates:
    """Template tokens of texts: ``token`` hashes, ``kind``, and the bytes of each core."""

    def __init__(self, texts: list[bytes]):
        self.words = w = common.PackedWords(texts)
        core = _CORE[w.buf]
        at = np.arange(len(core))
        after = np.minimum.accumulate(np.where(core, at, len(core))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(core, at, -1))
        start, end = after[w.start], before[w.end - 1] + 1
        bare = start >= w.end  # punctuation only: a literal as it stands
        self.start, self.end = np.where(bare, w.start, start), np.where(bare, w.end, end)
        self.low = _LOWER[w.buf]
        h = common.segment_hashes(self.low, self.start, self.end)
        first = w.buf[self.start]
        second = w.buf[np.minimum(self.start + 1, len(w.buf) - 1)]
        kind = np.where(_DIGIT[first], NUMBER, LITERAL)
        kind[_UPPER[first] | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)] = NAME
        behind = np.zeros(len(kind), bool)
        behind[1:] = (kind[:-1] == NUMBER) & (w.doc[1:] == w.doc[:-1])
        near = np.flatnonzero(behind & (kind == LITERAL))
        kind[near[np.isin(h[near], _unit_hashes())]] = UNIT
        self.kind = kind
        self.word, self.token = h, np.where(kind == LITERAL, h, _SLOT[kind])

    def telling(self, at: np.ndarray, size: int, least: tuple[int, int]) -> np.ndarray:
        """Whether the words from at on have text enough to be searched for alone; least: words and characters."""
        points = np.concatenate(([0], np.cumsum((self.words.buf & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(points[self.end] - points[self.start])))
        return chars[at + size] - chars[at] >= least[1] * (1 if size >= least[0] else 2)

    def windows(self, size: int, lone: bool = False, item: bool = False, rare: bool = True, least: tuple[int, int] = (LONE_WORDS, LONE_CHARS)) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Way, first words and hashes of the windows found that way; lone: only of texts of just that many words; rare: some window of the items is not literal enough."""
        at = self.words.windows(size)
        if lone:
            at = at[self.words.count[self.words.doc[at]] == size]
            at = at[self.telling(at, size, least)]
        literal = np.concatenate(([0], np.cumsum(self.kind == LITERAL)))
        enough = 2 * (literal[at + size] - literal[at]) >= size
        words = {DOC_WORDS: at if item else at[~enough], ITEM_WORDS: at[~enough] if item else at if rare else at[:0]}
        out = [(TEMPLATE, at[enough], common.rolling(self.token, size, common.BASE)[at[enough]] + _U(size))]
        if any(map(len, words.values())):
            h = common.rolling(self.word, size, common.BASE) + _U(size)
            out += [(way, k, h[k] ^ _WAY[way]) for way, k in words.items()]
        return out

    def slots(self, at: int, size: int) -> list[str]:
        found = at + np.flatnonzero(self.kind[at : at + size] != LITERAL)
        return [f"{self.kind[k]}{self.low[self.start[k] : self.end[k]].tobytes().decode('utf-8', 'replace')}" for k in found]


_units: np.ndarray | None = None


def _unit_hashes() -> np.ndarray:
    global _units
    if _units is None:
        w = common.PackedWords([u.encode() for u in UNITS])
        _units = w.hashes()
    return _units


_HIT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("hash", pa.int64()), ("way", pa.int32()), ("pos", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.string()))])


def _found(sizes: list[int], probe, lone: int, item: bool = False, rare: bool = True, least: tuple[int, int] = (LONE_WORDS, LONE_CHARS)):
    """Windows of rows (doc_id, key, text) whose hash is in probe (None: all); lone: shorter texts give one window of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = probe.value if probe is not None else None
        if known is not None:
            door = np.zeros(1 << 20, bool)
            door[known >> _U(44)] = True
        for batch in common.rows_of(batches):
            ids, keys = batch.column("doc_id"), batch.column("key")
            for row, texts in common.text_slices(batch.column("text")):
                t = Templates(texts)
                out: dict[str, list] = {name: [] for name in _HIT.names}
                for size in sizes:
                    for way, at, h in t.windows(size, size < lone, item, rare, least):
                        if known is not None:
                            ok = door[h >> _U(44)]
                            at, h = at[ok], h[ok]
                            ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                            at, h = at[ok], h[ok]
                        doc = t.words.doc[at]
                        out["doc_id"] += ids.take(pa.array(row + doc)).to_pylist()
                        out["key"] += keys.take(pa.array(row + doc)).to_pylist()
                        out["hash"] += h.view(np.int64).tolist()
                        out["way"] += [way] * len(at)
                        out["pos"] += (at - t.words.first[doc]).tolist()
                        out["size"] += [size] * len(at)
                        # equal words fill every slot alike
                        out["slots"] += [t.slots(k, size) if way == TEMPLATE else [] for k in at.tolist()]
                yield pa.RecordBatch.from_pydict(out, schema=_HIT)

    return run


_HIT_DDL = "doc_id long, key long, hash long, way int, pos int, size int, slots array<string>"


def item_windows(benchmark: DataFrame, window: int = WINDOW, lone_words: int = LONE_WORDS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """item_id, hash, way, item_pos, item_slots of each benchmark window; n_windows literal enough and n_all of the item."""
    items = benchmark.groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("doc_id")).select("doc_id", F.lit(0).cast("long").alias("key"), "text")
    rows = items.mapInArrow(_found(list(range(1, window + 1)), None, window, item=True, least=(lone_words, lone_chars)), _HIT_DDL)
    counted = rows.groupBy("doc_id").agg(F.count_if(F.col("way") == TEMPLATE).alias("n_windows"), F.count_distinct("pos").alias("n_all"))
    return rows.join(counted, "doc_id").select(F.col("doc_id").alias("item_id"), "hash", "way", F.col("pos").alias("item_pos"), "size", F.col("slots").alias("item_slots"), "n_windows", "n_all")


def too_short(benchmark: DataFrame, window: int = WINDOW, lone_words: int = LONE_WORDS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """item_id and text of the items that are not searched for: null, without words, or of too little text."""
    searched = item_windows(benchmark, window, lone_words, lone_chars).select("item_id").distinct().join(benchmark.select(F.col("item_id").cast("long"), "text"), "item_id").select("text")
    return benchmark.select("item_id", "text").join(searched, "text", "left_anti").select("item_id", "text")


_KEYS = ["doc_id", "key", "item_id", "n_windows", "n_all"]
_RUN = pa.schema([*[(k, pa.int64()) for k in _KEYS], ("at", pa.list_(pa.int32())), ("words_at", pa.list_(pa.int32())), ("alike", pa.bool_())])


def steady(windows: list[dict]) -> list[int]:
    """Positions of a run's windows (item_pos, item_slots, slots) that fill the item's slots consistently."""
    pairs = [list(zip(w["item_slots"], w["slots"])) for w in windows]
    seen = defaultdict(Counter)
    for own in pairs:
        for item, found in set(own):
            seen[item][found] += 1
    value = {item: min(n, key=lambda x: (-n[x], x)) for item, n in seen.items()}
    named = Counter(v for item, v in value.items() if item[0] == str(NAME))
    fits = lambda item, found: value[item] == found and (item[0] != str(NAME) or named[found] == 1)
    return [w["item_pos"] for w, own in zip(windows, pairs) if all(fits(*x) for x in own)]


def _steady_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        runs = batch.column("windows").to_pylist()
        found = [[[w for w in run if (w["way"] == TEMPLATE) == by] for by in (True, False)] for run in runs]
        alike = [all(w["item_slots"] == w["slots"] for w in run) for run in runs]
        columns = {"at": [steady(a) for a, _ in found], "words_at": [[w["item_pos"] for w in b] for _, b in found], "alike": alike}
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in _KEYS} | columns, schema=_RUN)


def telling_windows(items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """item_id and hash of the windows of which a document that leaks the item holds one at least: its rarest.

    Of n windows it must hold ceil(share * n), so it holds one of any n - ceil(share * n) + 1 of them.  Those are taken that the fewest items hold, of the
    windows found by templates, and of the places that windows found either way stand at.
    """
    held = items.join(items.groupBy("hash").agg(F.count_distinct("item_id").alias("held")), "hash")
    by_place = Window.partitionBy("item_id", "item_pos")
    placed = held.withColumn("at_place", F.max("held").over(by_place))
    ways = placed.withColumn("template", F.when(F.col("way") == TEMPLATE, F.struct("held", "item_pos"))).withColumn("place", F.struct("at_place", "item_pos"))
    own = Window.partitionBy("item_id")
    enough = lambda n: n - F.ceil(min_share * n) + 1
    ranked = ways.withColumn("t", F.dense_rank().over(own.orderBy(F.col("template").asc_nulls_last()))).withColumn("p", F.dense_rank().over(own.orderBy("place")))
    rare = ranked.where(F.col("template").isNotNull() & (F.col("t") <= enough(F.col("n_windows"))) | (F.col("p") <= enough(F.col("n_all"))))
    return rare.select("item_id", "hash").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, lone_words: int = LONE_WORDS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """With ``lone_chars=0`` every item that has a word is searched for.  doc_id, key (hash of the text), item_id, n_windows matched, share of the item's windows, verbatim (all slots filled alike)."""
    items = common.materialize(item_windows(benchmark, window, lone_words, lone_chars), "items")
    n, sizes, rare = items.agg(F.count_distinct("hash").alias("n"), F.collect_set("size").alias("sizes"), F.coalesce(F.max(F.col("way") == ITEM_WORDS), F.lit(False)).alias("rare")).first()
    if not n:
        sizes, n = [window], 0
    probe = None
    if n <= PROBE_WINDOWS:
        known = items.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(_U)
        probe = docs.sparkSession.sparkContext.broadcast(np.sort(known) if len(known) else np.zeros(1, _U))
    # any document may hold a short item, so every size is searched everywhere
    rows = common.small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    hits = rows.mapInArrow(_found(sorted(sizes), probe, 0, rare=rare), _HIT_DDL).drop("size", "way")
    hits = common.materialize(hits, "hits")
    pairs = common.materialize(hits.select("doc_id", "key", "hash").distinct().join(telling_windows(items, min_share), "hash").select("doc_id", "key", "item_id").distinct(), "pairs")
    # a window that many items hold meets only the pairs that a rarer one has shown
    of_pairs = hits.join(pairs, hits["doc_id"].eqNullSafe(pairs["doc_id"]) & (hits["key"] == pairs["key"])).select(hits["doc_id"], hits["key"], "hash", "pos", "slots", "item_id")
    joined = of_pairs.join(items.drop("size"), ["item_id", "hash"]).withColumn("offset", F.col("pos") - F.col("item_pos"))
    windows = joined.groupBy(*_KEYS, "offset").agg(F.collect_set(F.struct("way", "item_pos", "item_slots", "slots")).alias("windows"))
    ddl = ", ".join(f"{k} long" for k in _KEYS) + ", at array<int>, words_at array<int>, alike boolean"
    runs = windows.select(*_KEYS, "windows").mapInArrow(_steady_runs, ddl).where(F.size("at") + F.size("words_at") > 0)
    # by templates only the runs that hold some count, as does whether these are verbatim
    gathered = runs.groupBy(*_KEYS).agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("words_at")).alias("words_at"), F.min(F.when(F.size("at") > 0, F.col("alike"))).alias("steady_alike"), F.min("alike").alias("alike"))
    by_template, by_any = F.size(F.array_distinct("at")).cast("long"), F.size(F.array_union("at", "words_at")).cast("long")
    literal = F.coalesce(by_template / F.nullif("n_windows", F.lit(0)), F.lit(0.0))
    pick = lambda a, b: F.when(literal >= min_share, a).otherwise(b)
    share = pick(literal, by_any / F.col("n_all"))
    found = gathered.select("doc_id", "key", "item_id", pick(by_template, by_any).alias("n_windows"), share.alias("share"), pick(F.col("steady_alike"), F.col("alike")).alias("verbatim"))
    return found.where(F.col("share") >= min_share)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, lone_words: int = LONE_WORDS, lone_chars: int = LONE_CHARS) -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    found = leaks(docs.select("doc_id", "text"), benchmark, window, min_share, lone_words, lone_chars).select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__key")).distinct()
    found = common.narrow_side(common.materialize(found, "leaks"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__doc_id"]) & (F.xxhash64(docs["text"]) == found["__key"]), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", F.round("share", 6).alias("share"), "verbatim")
