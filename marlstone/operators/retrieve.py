"""Retrieval: BM25 over postings, cosine over vectors, rank fusion, top-k, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
WEIGHTS = (0.5, 0.3, 0.2)  # vector, keyword, metadata


@dataclass(frozen=True)
class KeywordIndex:
    """postings (term, node_id, tf, dl), terms (term, df, idf) and the mean document length."""

    postings: DataFrame
    terms: DataFrame
    avgdl: float


Tokenize = Callable[[Column], Column]


def tokenised(chunks: DataFrame, tokenize: Tokenize = T.tokens) -> DataFrame:
    """node_id and tokens; on its own, so that a plan tokenises a text once however often it uses the tokens."""
    return chunks.select("node_id", tokenize(F.col("text")).alias("tokens"))


def term_stats(words: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf; an idf below zero becomes EPSILON times the mean idf of all terms."""
    each = words.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term IS NOT NULL")
    return weighted(each.groupBy("term").agg(F.count("*").alias("df")), n_docs)


def weighted(df: DataFrame, n_docs: int) -> DataFrame:
    """term, df with idf."""
    raw = df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    # one row beside every term
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def each_token(words: DataFrame) -> DataFrame:
    """node_id, dl, term of each token.

    Outer, as a plain explode is given a filter on the array's size below it, for which every text is tokenised once more."""
    return words.select("node_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")


#: Tokens that are counted together (or those of one text), and postings of a term that are at most one row of ``blocks``.
COUNTED, BLOCK = 2_000_000, 256


def _counts(words: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, pa.RecordBatch]:
    """Distinct terms of some rows of words; of each posting, by term and row, the number of its term, and node_id, dl, tf."""
    tokens = words.column("tokens")
    each = pa.table({"row": pc.list_parent_indices(tokens), "term": pc.list_flatten(tokens)}).drop_null()
    term = each.column("term").combine_chunks().dictionary_encode()
    key, tf = np.unique(term.indices.to_numpy().astype(np.int64) * words.num_rows + each.column("row").to_numpy(), return_counts=True)
    row = pa.array(key % words.num_rows)
    columns = [words.column("node_id").take(row), pc.list_value_length(tokens).take(row), pa.array(tf, pa.int64())]
    return term.dictionary, key // words.num_rows, pa.RecordBatch.from_arrays(columns, ["node_id", "dl", "tf"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words in parts of about COUNTED tokens."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy(), dtype=np.int64)
        cuts = [*np.flatnonzero(np.diff(ends // COUNTED, prepend=-1)).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def counted(words: DataFrame) -> DataFrame:
    """term, node_id, dl, tf of each term of a row of words: each row is counted by itself, so nothing is shuffled or held for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            terms, number, rows = _counts(part)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(number)), *rows.columns], ["term", "node_id", "dl", "tf"])

    return words.mapInArrow(run, f"term string, node_id {words.schema['node_id'].dataType.simpleString()}, dl int, tf long")


def _blocks(terms: pa.Array, number: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings in the order of their terms' numbers, at most BLOCK of a term in a row."""
    first = np.flatnonzero(np.diff(number, prepend=-1))
    place = np.arange(len(number)) - np.repeat(first, np.diff(first, append=len(number)))
    cut = np.flatnonzero(place % BLOCK == 0)
    ends = pa.array(np.append(cut, len(number)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, column) for column in rows.columns]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(number[cut])), *lists], ["term", "nodes", "dls", "tfs"])


def _block_type(rows: DataFrame) -> str:
    return f"term string, nodes array<{rows.schema['node_id'].dataType.simpleString()}>, dls array<int>, tfs array<long>"


def blocks(words: DataFrame) -> DataFrame:
    """term, nodes, dls, tfs: what ``counted`` gives, with postings of a term side by side, so that few and short rows are shuffled and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            yield _blocks(*_counts(part))

    return words.mapInArrow(run, _block_type(words))


def in_blocks(postings: DataFrame) -> DataFrame:
    """``blocks`` of postings (term, node_id, dl, tf) that are counted already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = batch.column("term").dictionary_encode()
            number = term.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            yield _blocks(term.dictionary, number[order], batch.select(["node_id", "dl", "tf"]).take(pa.array(order)))

    return postings.select("term", "node_id", "dl", "tf").mapInArrow(run, _block_type(postings))


def out_of_blocks(rows: DataFrame, *more: str) -> DataFrame:
    """term, node_id, dl, tf (and more columns) of ``blocks``, in their order."""
    each = rows.select("term", "dls", "tfs", *more, F.posexplode("nodes").alias("__at", "node_id"))
    return each.select("term", "node_id", F.col("dls")[F.col("__at")].alias("dl"), F.col("tfs")[F.col("__at")].alias("tf"), *more)


def postings(words: DataFrame, only: list[str] | None = None) -> DataFrame:
    """term, node_id, tf, dl of each term of a chunk, or only of some terms (those of the queries at hand)."""
    rows = each_token(words)
    kept = rows if only is None else rows.where(F.col("term").isin(*only))
    return kept.groupBy("term", "node_id", "dl").agg(F.count("*").alias("tf"))


def keyword_index(chunks: DataFrame, only: list[str] | None = None, tokenize: Tokenize = T.tokens) -> KeywordIndex:
    """With ``only``, the statistics still cover all terms: scores are those of the full index.  Questions need the same ``tokenize``."""
    words = tokenised(chunks, tokenize)
    n, avgdl = words.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    return KeywordIndex(postings(words, only), term_stats(words, n), avgdl or 1.0)


def bm25(index: KeywordIndex, query_terms: DataFrame) -> DataFrame:
    """query_id, node_id, score > 0; query_terms: query_id, term (a repeated term counts again).

    Scores are rounded: sums in another order are equal, so ties go by node_id however the rows are dealt.
    """
    wanted = sinks.few(query_terms.groupBy("query_id", "term").agg(F.count("*").alias("times")))
    known = sinks.few(sinks.kept(index.terms.join(wanted, "term").select("query_id", "term", "times", "idf"), "terms"))
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / index.avgdl))
    return index.postings.join(known, "term").groupBy("query_id", "node_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def ranked(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """rank within a query by score, ties by node_id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "node_id")))


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """rows with their place, from 1, in the order of some columns: rows are dealt by range, and each range starts where those before it end.

    What reaches the driver is a count per range.
    """
    dealt = sinks.kept(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("__range").count().collect())
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    first = F.broadcast(dealt.sparkSession.createDataFrame(starts, "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return dealt.join(first, "__range").withColumn(name, place).drop("__range", "__before")


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    return ranked(scored, by).where(F.col("rank") <= k)


def best_per_node(scored: DataFrame) -> DataFrame:
    """The highest score of a node over several rewritten queries."""
    return scored.groupBy("node_id").agg(F.max("score").alias("score"))


def reciprocal(rank: Column) -> Column:
    """Reciprocal rank, 1 at rank 1; 0 for a node that the list lacks."""
    return F.coalesce((RRF + 1.0) / (RRF + rank), F.lit(0.0))


def fuse(vector: DataFrame, keyword: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Full outer union of two ranked lists (node_id, score, rank) with sources and the fused score; metadata: node_id, metadata_score."""
    v = vector.select("node_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = keyword.select("node_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = v.join(b, "node_id", "full_outer")
    if metadata is not None:
        both = both.join(metadata, "node_id", "left")
    meta = F.coalesce("metadata_score", F.lit(0.0)) if metadata is not None else F.lit(0.0)
    source = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("bm25_rank").isNull(), "vector").otherwise("both")
    final = WEIGHTS[0] * reciprocal(F.col("vector_rank")) + WEIGHTS[1] * reciprocal(F.col("bm25_rank")) + WEIGHTS[2] * meta
    return both.select("node_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), meta.alias("metadata_score"), source.alias("source"), final.alias("final_score"))


def relative_threshold(scored: DataFrame, courses: int) -> DataFrame:
    """Keep scores near the best; if all are below -10, fall back to the metadata score (at most the top three)."""
    scored = sinks.kept(scored, "scored")  # the maximum and the filter both read it
    ratio = 0.15 if courses > 1 else 0.40 if courses == 1 else 0.25
    top, meta = scored.agg(F.max("final_score"), F.max("metadata_score")).first()
    if top is None or top >= -10:
        return scored if top is None or top <= 0.5 else scored.where(F.col("final_score") >= ratio * top)
    if meta >= -50 and meta > 0:
        return scored.where(F.col("metadata_score") >= meta * 0.5)
    return scored.orderBy(F.desc("metadata_score"), "node_id").limit(3)


def rerank_blend(cross: Column, metadata: Column) -> Column:
    """Three quarters of the cross-encoder's sigmoid, one quarter of the metadata score."""
    return 0.75 / (1.0 + F.exp(-cross)) + 0.25 * metadata


def contextual_boost(section: Column, info_type: Column, intent: str, words: set[str]) -> Column:
    terms = []
    if words & {"時間", "推薦", "time", "recommend"}:
        terms.append(F.when(section == "basic_info", 0.10).otherwise(0.0))
    if words & {"研究", "內容", "research"}:
        terms.append(F.when(section.isin("objectives", "syllabus"), 0.20).otherwise(0.0))
    if intent == "professor_info":
        terms.append(F.when(info_type == "professor_info", 0.50).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def first_file(scored: DataFrame) -> DataFrame:
    """Of chunks of one course, section, teacher and term keep those of the best chunk's file; rows without a course stay."""
    w = Window.partitionBy("course_name", "section", "teacher", "academic_year", "semester").orderBy(F.desc("score"), "node_id")
    best = scored.where("course_name IS NOT NULL").withColumn("__first", F.first("source_file").over(w)).where("source_file = __first").drop("__first")
    return best.unionByName(scored.where("course_name IS NULL"))


def coverage(scored: DataFrame) -> DataFrame:
    """The best chunk of each course, a basic_info or syllabus chunk before any other; rows without a course all stay."""
    preferred = F.col("section").isin("basic_info", "syllabus")
    w = Window.partitionBy("course_name").orderBy(preferred.desc(), F.desc("score"), "node_id")
    one = scored.where("course_name IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one.unionByName(scored.where("course_name IS NULL"))


def covered_top(scored: DataFrame, top_n: int) -> DataFrame:
    """Coverage rows, then the best others up to max(top_n, covered + 5) rows."""
    scored = sinks.kept(scored, "scored")  # the count and the union both read it
    sure = coverage(scored).withColumn("guaranteed", F.lit(True))
    room = max(top_n, sure.count() + 5)
    rest = scored.join(sure.select("node_id"), "node_id", "left_anti").withColumn("guaranteed", F.lit(False))
    return sure.unionByName(rest).orderBy(F.desc("guaranteed"), F.desc("score"), "node_id").limit(room)


def inject(found: DataFrame, more: DataFrame, source: str = "intent_inject") -> DataFrame:
    """Upsert: a node already found takes the larger metadata score and the new source; others are appended."""
    extra = more.select("node_id", F.col("metadata_score").alias("__meta"))
    joined = found.join(extra, "node_id", "full_outer")
    meta = F.greatest(F.coalesce("metadata_score", "__meta"), F.coalesce("__meta", "metadata_score"))
    kept = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vector_score", "bm25_score", "final_score")]
    return joined.select("node_id", *kept, meta.alias("metadata_score"), F.when(F.col("__meta").isNotNull(), source).otherwise(F.col("source")).alias("source"))


def citations(scored: DataFrame) -> DataFrame:
    """The first chunk, by rank, of each course and section."""
    w = Window.partitionBy("course_name", "section").orderBy("rank")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: the same at every run and partitioning."""
    return rows.withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__order", key).limit(n).drop("__order")
