"""From chunks to an index on disk, and from a routed question to ranked evidence and an answer.

The models are parameters: vectors of questions come from any embedder, ``cross`` is any
cross-encoder as a Column, and the answerer defaults to the best chunk's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inject as I
from ..operators import match as M
from ..operators import nearest as N
from ..operators import retrieve as R
from ..sources import sinks
from .route import Route, dispatch
from .storage import Index, build, build_keywords, compact, document_index, folder_of, load, read_keywords, refresh, reloaded  # noqa: F401

SEARCH_K, RERANK_N, RERANK_N_PROFESSOR = 30, 10, 25


def in_memory(chunks: DataFrame, vectors: DataFrame, only: list[str] | None = None, tokenize: R.Tokenize = T.tokens) -> Index:
    return Index(chunks, R.keyword_index(chunks, only, tokenize), vectors)


def query_terms(spark: SparkSession, queries: list[str], tokenize: R.Tokenize = T.tokens) -> DataFrame:
    """query_id, term of each question: stop words and single characters dropped.  The tokenizer is the index's."""
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id int, q string")
    return rows.select("query_id", F.explode(T.query_tokens(F.col("q"), tokenize)).alias("term"))


def keyword_scores(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, node_id, score."""
    return scores_of(index.keyword, terms) if index.split else R.bm25(index.keyword, terms)


#: Distinct terms of questions that are named in the plan, so that files and row groups without them are left out; more are joined.
MOST_TERMS = 1_000


def scores_of(k: R.KeywordIndex, terms: DataFrame) -> DataFrame:
    """query_id, node_id, score by a stored index, of which the questions' terms are read only."""
    asked = terms.select("term", folder_of("term").alias("folder")).distinct().limit(MOST_TERMS + 1).collect()  # bounded
    if len(asked) > MOST_TERMS:
        return R.bm25(k, terms)
    folders, words = sorted({r.folder for r in asked}), [r.term for r in asked]
    return R.bm25(R.KeywordIndex(k.postings.where(F.col("folder").isin(*folders) & F.col("term").isin(*words)), k.terms.where(F.col("term").isin(*words)), k.avgdl), terms)


def search(index: Index, filters: M.Filters, terms: DataFrame, vectors: list[tuple[int, list[float]]], top_k: int = SEARCH_K) -> DataFrame:
    """The ``top_k`` best of both lists, of chunks injected by metadata, and their metadata scores: columns of ``fuse``."""
    one = lambda scored: R.best_per_node(R.top_k(scored, top_k)).withColumn("q", F.lit(0))
    asked = index.chunks.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "query_id long, embedding array<double>")
    near = N.nearest(index.vectors, asked, top_k).where("score > 0")
    near = sinks.kept(R.ranked(one(near), "q"), "near")  # at most top_k rows a question
    found = sinks.kept(R.top_k(one(keyword_scores(index, terms)), top_k * max(1, len(vectors)), "q"), "found")
    seen = F.broadcast(near.select("node_id").union(found.select("node_id")).distinct())
    more = I.by_metadata(index.chunks, filters).join(seen, "node_id", "left_anti").select("node_id", F.lit(0.001).alias("score"), F.lit(0).alias("q"))
    # injected rows stand behind those that were found, by node
    behind = R.numbered(more, "node_id").select("node_id", "score", "q", (F.col("n") + near.count()).alias("rank"))
    v = near.unionByName(behind)
    listed = v.select("node_id").union(found.select("node_id")).distinct()
    meta = index.chunks.join(listed, "node_id", "left_semi").select("node_id", (M.normal_score(filters) + M.soft_score(filters)).alias("metadata_score"))
    return R.fuse(v, found, meta).orderBy(F.desc("final_score"), "node_id").limit(top_k)


def evidence(index: Index, route: Route, terms: DataFrame, vectors: list[tuple[int, list[float]]], cross: Callable[[Column], Column] | None = None, words: set[str] | None = None) -> DataFrame:
    """node_id, rerank_score, source and the chunk's columns, best first: search, intent rows, reranking, one file per course,
    a threshold, and the coverage of all courses where the question is about courses."""
    found = search(index, route.filters, terms, vectors)
    extra = I.by_intent(index.chunks, route.query_type, route.filters.wanted.get("teacher"))
    merged = R.inject(found, extra)
    if route.is_career_planning and not {"course_name_keyword", "teacher", "classroom", "ge_domain"} & route.filters.wanted.keys():
        department = (route.filters.wanted.get("dept_short") or [None])[0]
        year, term = ((route.filters.wanted.get(k) or [""])[0] for k in ("academic_year", "semester"))
        merged = R.inject(merged, I.curriculum(index.chunks, department, year, term), "full_curriculum_scan")
    surrogate = cross or (lambda c: c / (1 + c))
    rows = index.chunks.join(merged.withColumn("meta", F.coalesce("metadata_score", F.lit(0.0))).drop("metadata_score"), "node_id")
    blended = R.rerank_blend(surrogate(F.col("bm25_score")), F.col("meta")) + R.contextual_boost(F.col("section"), F.col("info_type"), route.query_type, words or set())
    scored = R.first_file(rows.withColumn("score", blended)).withColumn("final_score", F.col("score")).withColumn("metadata_score", F.col("meta"))
    kept = R.relative_threshold(scored, len(route.filters.wanted.get("course_name_keyword", [])))
    top_n = RERANK_N_PROFESSOR if route.query_type == "professor_info" else RERANK_N
    if route.is_career_planning:
        return kept.orderBy(F.desc("score"), "node_id")
    if route.query_type == "course_info" or {"teacher", "required_or_elective"} & route.filters.wanted.keys():
        return R.covered_top(kept, top_n)
    return kept.orderBy(F.desc("score"), "node_id").limit(top_n)


def context(rows: DataFrame) -> DataFrame:
    """rank, block: the evidence as text blocks under their headers, markup escaped."""
    head = F.concat_ws(" ", F.concat(F.lit("["), F.coalesce("course_name", F.lit("-")), F.lit("]")), "teacher", "schedule")
    ranked = R.ranked(rows.withColumn("__q", F.lit(0)), "__q")  # a request's short list
    return ranked.select("rank", "node_id", F.concat(head, F.lit("\n"), T.escape_markup(F.col("text"))).alias("block"))


NOTHING = "No data fits these conditions; try fewer of them."


def answer(index: Index, route: Route, queries: list[str], vectors: list[tuple[int, list[float]]], answerer: Callable[[list[str]], str] | None = None) -> str:
    """The answer to a routed question; by default the text of the best block, and a fixed reply if nothing is found."""
    if dispatch(route) != "retrieval":
        raise ValueError(f"{dispatch(route)} handles this question")
    terms = query_terms(index.chunks.sparkSession, list(route.search_queries) or queries)
    blocks = [r.block for r in context(evidence(index, route, terms, vectors)).orderBy("rank").collect()]  # at most the top rows of a request
    if not blocks:
        return NOTHING
    return answerer(blocks) if answerer else blocks[0]
