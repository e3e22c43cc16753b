"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the 64-bit majority vote over the XXH64 (seed 42) of its word
shingles.  Two fingerprints within ``radius`` (even) bits of each other have a value
within ``radius / 2`` bits of both in common.  So every distinct fingerprint emits all
values within half the radius; the shuffle brings fingerprints that share a value
together.  At most ``1 + 64`` (for radius 2) fingerprints can share one, and all of those
are within the radius of each other, so linking each to the smallest of them
loses no connection and needs no pairs within a group.  Links are made distinct and
verified, and components are found by alternating star contractions whose
rounds are written to the shared folder.

``keep_one_similar`` keeps one text of each group of texts that share ``SIMILARITY`` of their 5-word
shingles.  Texts with the same set of shingles are one node.  Each node gets ``SEEDS`` fingerprints of ``BITS`` bits
over its distinct words (an edit changes few of those); ball hashing brings nodes that are within the radius
under any seed to a common value, and every link is verified on the sets of shingles.  Fingerprints that share a value
are compared in pairs up to ``ALL_PAIRS`` of them, else each with ``REPS`` of them, others for each value; of a
fingerprint that many nodes have ``REPS`` nodes stand for it.  Copies in a crowd are mostly connected by that. What is
left is then compared exactly (``unmet_pairs``): in every crowd whose nodes are not all connected, those outside its largest component
with all that they are not connected to, by sizes and parities first, so that few dissimilar pairs become rows.  So the groups are those that comparing all that meet gives, and pairs within a component cost nothing.

Defined results: null or empty texts have fingerprint zero and one (empty) set of shingles; a text of fewer words than a
shingle is one shingle; rows with equal doc_id are separate rows, but rows equal in doc_id and text stay or go
together; a null doc_id gets a component like any row, but is never a component's id unless all its ids are null;
texts of any length count whole; empty tables give no rows; keep_one and keep_one_similar return the
columns of docs, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Of keep_one_similar: words a shingle, and the least share of shingles that two texts have in common.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Bits of its fingerprints (packed with the seed and the place of a flipped bit in 63) and how many a text has.
BITS, SEEDS = 48, 6
#: Fingerprints at a value that are all compared with each other; fingerprints, or nodes of one, that stand for larger crowds.
ALL_PAIRS, REPS = 8, 2

_U = np.uint64
_LANES = _U(0x0001000100010001)


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    words = raw.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return np.empty(0, _U)
    text = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    k = min(size, len(words))
    parts = map(text.__getitem__, map(slice, start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), _U, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the values, as a signed integer; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65535):  # a lane of 16 bits holds a count up to that
        part = hashes[at : at + 65535]
        for shift in range(16):
            total = int(((part >> _U(shift)) & _LANES).sum())
            counts[shift::16] += [total >> lane & 0xFFFF for lane in (0, 16, 32, 48)]
    value = sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str, distinct: bool = False) -> DataFrame:
    """doc_id and fingerprint (long) of each row, and the long columns named in keep.

    distinct: a repeated shingle votes once.  With single words that brings edited copies closer together.
    """
    votes = (lambda raw: np.unique(shingle_hashes(raw, shingle))) if distinct else (lambda raw: shingle_hashes(raw, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            prints = [majority(votes(raw)) for _, run in common.text_slices(batch.column("text")) for raw in run]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(prints, pa.int64())} | {k: batch.column(k) for k in keep})

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fingerprint", *keep)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), v < u: links that connect all fingerprints within the radius, directly or through others."""
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4: with an odd one, sharing a value does not prove a link")
    masks = [_signed(sum(1 << b for b in bits)) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    ball = F.explode(F.transform(F.lit(masks), lambda m: F.col("fingerprint").bitwiseXOR(m)))
    spread = distinct.repartition(2 * distinct.sparkSession.sparkContext.defaultParallelism, "fingerprint")  # as they come, few small files may hold them all
    shared = spread.select("fingerprint", ball.alias("value")).groupBy("value").agg(F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1)
    pairs = shared.select(F.array_min("members").alias("v"), F.explode("members").alias("u")).where("u != v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: root is the smallest node that it is connected to.

    Each round points every larger neighbour at the smallest one it knows of
    (first among all neighbours, then among smaller ones); done when nothing changes.
    """
    e = common.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        e = common.materialize(small, "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fingerprint, ...) with root, the component's smallest fingerprint, and component_id, the smallest doc_id reachable over links.

    Only fingerprints that several rows or links have are sent back to the rows: by broadcast up to common.BROADCAST_ROWS, else by a join of two plain
    exchanges, whose hot keys adaptive execution splits.
    """
    distinct = common.materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "doc", "n", F.coalesce("root", "fingerprint").alias("root"), F.col("root").isNotNull().alias("linked"))
    shared = rooted.where("linked OR n > 1")
    ids = shared.groupBy("root").agg(F.min("doc").alias("component_id"))
    found = common.materialize(shared.join(ids, "root").select("fingerprint", "root", "component_id"), "roots")
    joined = prints.join(common.narrow_side(found), "fingerprint", "left")
    alone = F.col("root").isNull()
    return joined.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("root", F.coalesce("root", "fingerprint"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, distinct: bool = False) -> DataFrame:
    """docs, all columns, less all rows of a component but one: that of the smallest doc_id (null last), then the smallest hash of the text.

    Repeated rows, equal in doc_id and text, are one document and stay or go together."""
    prints = common.materialize(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), shingle, "key", distinct=distinct), "prints")
    found = near_duplicates(prints, radius).withColumn("null_id", F.col("doc_id").isNull())
    kept = found.groupBy("root").agg(F.min(F.struct("null_id", "doc_id", "key")).alias("first"))
    gone = found.join(kept, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))))
    return _without(docs, gone.select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__key")).distinct())


def set_of(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def shingle_sets(words: common.PackedWords, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and the text of each."""
    h = words.hashes()
    found, docs = [], []
    for k in range(1, size + 1):
        at = words.windows(size) if k == size else words.first[words.count == k]
        found.append(common.rolling(h, k, common.BASE)[at])
        docs.append(words.doc[at])
    return set_of(np.concatenate(found), np.concatenate(docs))


def word_prints(words: common.PackedWords, bits: int = BITS, seeds: int = SEEDS) -> np.ndarray:
    """A row of fingerprints per text: the majority votes of its distinct words under each seed."""
    h, doc = set_of(words.hashes(), words.doc)
    n = np.bincount(doc, minlength=len(words.texts))
    first = np.cumsum(n) - n
    out = np.zeros((len(n), seeds), _U)
    # a lane of 16 bits holds a count up to 65535, so longer texts are summed in parts
    start = np.concatenate([np.arange(a, a + m, 65535) for a, m in zip(first.tolist(), n.tolist(), strict=True)]).astype(np.int64)
    if not len(start):
        return out
    owner = doc[start]
    for k, salt in enumerate(common.mix(np.arange(1, seeds + 1, dtype=_U))):
        vote = common.mix(h ^ salt)
        for shift in range(16):
            total = np.add.reduceat((vote >> _U(shift)) & _LANES, start)
            for lane in range(0, bits, 16):
                count = np.bincount(owner, (total >> _U(lane)) & _U(0xFFFF), len(n))
                out[:, k] |= (2 * count > n).astype(_U) << _U(shift + lane)
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("prints", pa.list_(pa.int64()))])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (both of docs), node (hash of the set of shingles), its size and the fingerprints (seed above BITS bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(SEEDS, dtype=_U) << _U(BITS)
        for batch in common.rows_of(batches):
            nodes, sizes, prints = [], [], []
            for _, part in common.text_slices(batch.column("text")):
                words = common.PackedWords([raw.lower() for raw in part])
                h, doc = shingle_sets(words, SIMILAR_SHINGLE)
                n = np.bincount(doc, minlength=len(part))
                nodes += [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in np.split(h, np.cumsum(n)[:-1])]
                sizes += n.tolist()
                prints += (word_prints(words) | seeds).astype(np.int64).tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "node": nodes, "size": sizes, "prints": prints}, schema=_SKETCH)

    return common.small_batches(docs).mapInArrow(run, "doc_id long, key long, node long, size long, prints array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """node and shingles (32 bits of each distinct hash) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            for row, part in common.text_slices(batch.column("text")):
                h, doc = shingle_sets(common.PackedWords([raw.lower() for raw in part]), SIMILAR_SHINGLE)
                ends = np.cumsum(np.bincount(doc, minlength=len(part)))
                held = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((h >> _U(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(row, len(part)), "shingles": held})

    return common.small_batches(docs).select("node", "text").mapInArrow(run, "node long, shingles array<int>")


def meeting_pairs(value: np.ndarray, prints: np.ndarray, all_pairs: int | None = ALL_PAIRS, reps: int | None = REPS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the prints at each value (values sorted): all of them, or of more than all_pairs each with the reps that come first by lot."""
    if all_pairs is None or reps is None:
        all_pairs, reps = len(value), 1
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    size = np.diff(np.append(start, len(value)))
    lot = common.mix(prints.view(_U) ^ common.mix(value.view(_U)))
    order = np.lexsort((lot, value))
    place = np.arange(len(value)) - np.repeat(start, size)
    most = np.where(size <= all_pairs, size, reps)
    pairs = []
    for k in range(1, int(most.max(initial=1))):  # each print with the k-th before it, or with the k-th of the crowd
        few = np.flatnonzero((place >= k) & np.repeat(size <= all_pairs, size))
        pairs.append((order[few], order[few - k]))
    for k in range(reps):
        crowd = np.flatnonzero((place > k) & np.repeat(size > all_pairs, size))
        pairs.append((order[crowd], order[np.repeat(start, size)[crowd] + k]))
    u, v = (prints[np.concatenate(x)] for x in zip(*pairs, strict=True))
    return np.minimum(u, v), np.maximum(u, v)


def collisions(prints: DataFrame, all_pairs: int | None = ALL_PAIRS, most_reps: int | None = REPS) -> DataFrame:
    """(p, q, crowd), p < q: pairs of distinct prints (seed above BITS bits) that have a value within a bit of either in common; crowd is null.

    Of a value that more than all_pairs share, not all pairs are given, but each print p with the value as its crowd; q is null."""
    masks = [0, *(1 << b for b in range(BITS))]
    ball = F.explode(F.array(*[F.shiftleft(F.col("print").bitwiseXOR(F.lit(m)), 6).bitwiseOR(F.lit(k)) for k, m in enumerate(masks)]))
    # as they come, few small files may hold all of them
    spread = prints.repartition(2 * prints.sparkSession.sparkContext.defaultParallelism, "print").select(ball.alias("packed"))
    dealt = spread.repartition(F.shiftright("packed", 6)).sortWithinPartitions("packed")
    flip = np.array(masks, np.int64)

    def met(rows: np.ndarray) -> pa.RecordBatch:
        value = rows >> 6
        same = np.append(False, value[1:] == value[:-1])
        held = same | np.append(same[1:], False)
        value = value[held]
        own = value ^ flip[rows[held] & 63]
        u, v = meeting_pairs(value, own, all_pairs, most_reps)
        _, place, size = np.unique(value, return_inverse=True, return_counts=True)
        many = size[place] > (len(value) if all_pairs is None or most_reps is None else all_pairs)
        p, q = np.concatenate([u, own[many]]), pa.array(np.concatenate([v, own[many]]), mask=np.arange(len(u) + many.sum()) >= len(u))
        return pa.RecordBatch.from_pydict({"p": p, "q": q, "crowd": pa.array(np.concatenate([v, value[many]]), mask=np.arange(len(p)) < len(u))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty(0, np.int64)  # rows of the open value: at most one per mask
        for batch in common.rows_of(batches):
            rows = np.concatenate([rest, batch.column("packed").to_numpy()])
            last = np.searchsorted(rows >> 6, rows[-1] >> 6)
            rest = rows[last:]
            yield met(rows[:last])
        yield met(rest)

    return dealt.mapInArrow(run, "p long, q long, crowd long").distinct()


def candidates(nodes: DataFrame, all_pairs: int | None = ALL_PAIRS, most_reps: int | None = REPS) -> tuple[DataFrame, DataFrame | None]:
    """(u, v), u < v, and ``crowds`` (crowd, print) of which not all pairs are given (None: there are none): pairs of nodes (node, size, prints) with a fingerprint, or two within the radius, under some seed, whose sizes allow for the similarity.

    most_reps None: every node is compared with all that it meets.
    """
    crowds, own = None, F.struct("node", "size")
    prints = nodes.select(own.alias("a"), F.explode("prints").alias("print"))
    side = lambda rows, name, columns: rows.select(F.col("print").alias(name), *columns)
    if most_reps is None:
        prints = common.materialize(prints, "node-prints")
        near = collisions(prints.select("print").distinct(), all_pairs, most_reps)
        across = near.join(side(prints, "p", ["a"]), "p").join(side(prints, "q", [F.col("a").alias("b")]), "q").select("a", "b")
        within = prints.join(prints.select("print", F.col("a").alias("b")), "print").select("a", "b")
    else:
        numbered = prints.select("print", "a", F.xxhash64("print", "a.node").alias("lot"))
        first = Window.partitionBy("print").orderBy("lot", "a.node")
        reps = common.materialize(numbered.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most_reps).groupBy("print").agg(F.collect_list("a").alias("reps")), "reps")
        met = common.materialize(collisions(reps.select("print"), all_pairs, most_reps), "near")
        near = met.where("crowd IS NULL").select("p", "q")
        # neither are all nodes of a print that stand behind its reps compared, with each other or across
        heavy = common.materialize(prints.groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") > most_reps).select("print"), "heavy")
        beside = near.join(heavy.withColumnRenamed("print", "p"), "p", "left_semi").unionByName(near.join(heavy.withColumnRenamed("print", "q"), "q", "left_semi"))
        pairs = beside.select(F.xxhash64("p", "q").alias("crowd"), F.explode(F.array("p", "q")).alias("print"))
        alone = heavy.select(F.xxhash64("print").alias("crowd"), "print")
        crowds = common.materialize(met.where("crowd IS NOT NULL").select("crowd", F.col("p").alias("print")).unionByName(pairs).unionByName(alone).distinct(), "crowds")
        held = lambda name: side(reps, name, [F.col("reps").alias(f"{name}_reps")])
        across = near.join(held("p"), "p").join(held("q"), "q").select(F.explode("p_reps").alias("a"), "q_reps").select("a", F.explode("q_reps").alias("b"))
        within = prints.join(reps.where(F.size("reps") > 1), "print").select("a", F.explode("reps").alias("b"))
    return _fitting(across.unionByName(within)), crowds


def _fit() -> F.Column:
    """Whether the sizes of a and b allow for the similarity."""
    return F.least("a.size", "b.size") >= SIMILARITY * F.greatest("a.size", "b.size")


def _fitting(met: DataFrame) -> DataFrame:
    """(u, v) of pairs a, b of different nodes whose sizes allow for the similarity."""
    return _pairs(met.where(_fit() & (F.col("a.node") != F.col("b.node"))))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


#: Deals of a large crowd's nodes that are compared with the rest of it, so that it is the work of several tasks; nodes of a crowd for each deal.
DEALS, DEAL_NODES = 8, 256


def parities(docs: DataFrame) -> DataFrame:
    """node and parity of rows (node, text): a bit for each slot that an odd number of the text's shingles (32 bits of each hash) falls into.

    There are at least two slots a shingle, and 512.  Texts whose parities differ in more bits than similar texts have shingles apart are not similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            for row, part in common.text_slices(batch.column("text")):
                h, doc = shingle_sets(common.PackedWords([raw.lower() for raw in part]), SIMILAR_SHINGLE)
                words = np.array([8 << max(0, int(2 * n - 1).bit_length() - 9) for n in np.bincount(doc, minlength=len(part)).tolist()], np.int64)
                ends = np.append(0, np.cumsum(words))
                h, doc = set_of(h >> _U(32), doc)
                slot = (h & (words[doc] * 64 - 1).astype(_U)).astype(np.int64)
                held = np.zeros(ends[-1], _U)
                np.bitwise_xor.at(held, ends[doc] + (slot >> 6), _U(1) << (slot & 63).astype(_U))
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(row, len(part)), "parity": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(held.view(np.int64)))})

    return common.small_batches(docs).select("node", "text").mapInArrow(run, "node long, parity array<long>")


def _may_be_similar(a: str, b: str) -> F.Column:
    """False only where the parities show that the nodes (structs with size and parity, of sizes that fit) are not similar."""
    n = F.least(F.size(f"{a}.parity"), F.size(f"{b}.parity"))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda p: F.when(F.size(p) > n, F.zip_with(F.slice(p, 1, n), F.slice(p, n + 1, n), xor)).otherwise(F.col(p))  # noqa: E731  of sizes that fit one has twice the slots at most
    apart = F.aggregate(F.zip_with(folded(f"{a}.parity"), folded(f"{b}.parity"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda x, y: x + y)
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col(f"{a}.size") + F.col(f"{b}.size"))
    return apart <= most + 1e-6


def unmet_pairs(docs: DataFrame, nodes: DataFrame, crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes (node, size, prints, first) of a crowd (crowd, print) that roots (node, root) do not connect yet, and that may be similar.

    All are compared, by sizes and parities, inside the join: only those that these do not rule out, which few dissimilar ones are, become rows."""
    rooted = nodes.select("node", "size", "prints").join(roots, "node", "left")
    members = common.materialize(rooted.select(F.struct("node", "size").alias("a"), F.coalesce("root", "node").alias("root"), F.explode("prints").alias("print")), "members")
    ends = members.groupBy("print").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    split = crowds.join(ends, "print").groupBy("crowd").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("crowd")
    held = common.materialize(crowds.join(split, "crowd").join(members, "print").select("crowd", "a", "root").distinct(), "crowded")
    found = common.materialize(parities(_first_texts(docs, nodes, held.select("a.node").distinct())).dropDuplicates(["node"]), "parities")
    held = held.join(found, F.col("a.node") == found["node"]).select("crowd", "root", F.struct("a.node", "a.size", "parity").alias("a"))
    main = held.groupBy("crowd", "root").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.least(F.sum("n") / DEAL_NODES + 1, F.lit(DEALS)).cast("int").alias("deals"))
    held = common.materialize(held.join(main, "crowd"), "dealt")
    few = held.where("root != main").select("crowd", F.col("root").alias("few_root"), F.col("a").alias("b"), F.pmod(F.xxhash64("a.node"), F.col("deals")).cast("int").alias("deal"))
    dealt = held.select("crowd", "main", "root", "a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    once = (F.col("root") == F.col("main")) | (F.col("a.node") < F.col("b.node"))  # two outside the largest component meet from either side
    return _pairs(dealt.join(few, ["crowd", "deal"]).where((F.col("root") != F.col("few_root")) & once & _fit() & _may_be_similar("a", "b")))


def _first_texts(docs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, key, text) that stand for the nodes of ends, with their node."""
    firsts = common.materialize(nodes.join(ends, "node").select("node", F.col("first.doc_id").alias("__doc_id"), F.col("first.key").alias("__key")), "ends")
    few = common.narrow_side(firsts)
    return docs.join(few, docs["doc_id"].eqNullSafe(few["__doc_id"]) & (docs["key"] == few["__key"]))


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): pairs that share enough of their shingles, from nodes (node, first) and docs (doc_id, key, text); 32 bits of each shingle's hash are compared."""
    pairs = common.materialize(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("node")).distinct().union(pairs.select("v").distinct()).distinct()
    shingles = common.materialize(sets(_first_texts(docs, nodes, ends)).dropDuplicates(["node"]), "shingles")
    side = lambda name: shingles.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(both >= SIMILARITY * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that gone (__doc_id, __key) names by id and hash of the text."""
    gone = common.narrow_side(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__doc_id"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left_anti")


def keep_one_similar(docs: DataFrame, all_pairs: int | None = ALL_PAIRS, most_reps: int | None = REPS) -> DataFrame:
    """docs, all columns, less all rows but one of each group of texts that are linked by similarity; which one is as in keep_one.

    all_pairs: fingerprints at a value up to which all are compared with each other; most_reps: fingerprints, and nodes of one fingerprint, that stand for
    larger crowds at first; the pairs that this leaves unconnected are compared afterwards.  None for either compares all that meet at once, and the work
    grows with the square of a crowd; the rows that stay are the same.
    """
    if all_pairs is None or most_reps is None:
        all_pairs = most_reps = None
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    rows = common.materialize(sketches(plain), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key")).alias("first")
    nodes = common.materialize(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("prints").alias("prints"), first), "nodes")
    met, crowds = candidates(nodes, all_pairs, most_reps)
    links_ = common.materialize(similar_links(plain, nodes, met), "similar")
    roots = components(links_)
    if crowds is not None:
        unmet = common.materialize(unmet_pairs(plain, nodes, crowds, roots), "unmet")
        if not unmet.isEmpty():
            roots = components(links_.unionByName(similar_links(plain, nodes, unmet)))
    rooted = nodes.select(F.col("node").alias("own"), "first").join(roots, F.col("own") == F.col("node"), "left").select("own", "first", F.coalesce("root", "own").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    found = rows.join(rooted.select("own", "root").join(kept, "root"), F.col("node") == F.col("own"))
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))))
    return _without(docs, common.materialize(gone.select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__key")).distinct(), "gone"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    prints = common.materialize(fingerprints(common.read(spark, sf_dir, "documents")), "prints")
    found = near_duplicates(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
