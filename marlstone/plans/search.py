"""Queries of retrieval, filtering, fusion and reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import inject as I
from ..operators import match as M
from ..operators import nearest as N
from ..operators import retrieve as R
from ..sources import sinks
from . import engine
from .mapping import CHUNKS_SQL, chunks, query_vectors, table, vectors
from .route import Route

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The words asked for, by query; a repeated one counts again.
ASKED = {0: ["the", "and", "tion", "there"], 1: ["las", "con", "de", "de"], 2: ["der", "und", "token"]}
MULTI = {0: ["the", "and"], 1: ["and", "that"], 2: ["der"]}


def _terms(spark, asked: dict):
    return spark.createDataFrame([(q, w) for q, words in asked.items() for w in words], "query_id int, term string")


def _bm25(spark, sf_dir, asked: dict):
    return engine.scores_of(engine.document_index(spark, sf_dir), _terms(spark, asked))


def _values(asked: dict) -> str:
    return ", ".join(f"({q}, '{w}')" for q, words in asked.items() for w in words)


def _bm25_sql(asked: dict) -> str:
    return f"""
tok AS (SELECT doc_id AS node_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
post AS (SELECT node_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS node_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (VALUES {_values(asked)}) v(query_id, term) GROUP BY ALL),
bm AS (SELECT query_id, node_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
       FROM post JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (node_id), st GROUP BY ALL HAVING score > 0)"""


_COS = """
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
cs AS (SELECT query_id, vec_id AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) + 0.0 AS score FROM embeddings, qv)"""


def _nearest(spark, sf_dir, k: int = 30):
    """The k nearest of all vectors of every hundredth one."""
    rows = vectors(spark, sf_dir)
    return N.nearest(rows, rows.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id"), k)


@query(f"WITH {_bm25_sql(ASKED)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM bm) SELECT query_id, node_id, rank, round(score, 5) AS score FROM r WHERE rank <= 30")
def bm25_topk(spark, sf_dir):
    return R.top_k(_bm25(spark, sf_dir, ASKED), 30).select("query_id", "node_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM cs) SELECT query_id, node_id, rank, score FROM r WHERE rank <= 30")
def vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir).select("query_id", "node_id", "rank", "score")


@query(f"WITH {_bm25_sql(MULTI)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM bm), k AS (SELECT * FROM r WHERE rank <= 30) SELECT node_id, round(max(score), 5) AS score FROM k GROUP BY node_id")
def multi_query_topk(spark, sf_dir):
    return R.best_per_node(R.top_k(_bm25(spark, sf_dir, MULTI), 30)).select("node_id", F.round("score", 5).alias("score"))


#: Of every 40 documents one file is deleted, one changed and one copied to a new file.
_CHANGED = """docs AS (SELECT doc_id, CASE WHEN doc_id % 40 = 1 THEN text || ' the there' ELSE text END AS text FROM documents WHERE doc_id % 40 <> 0
UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 40 = 2),"""


@query(f"WITH {_CHANGED} {_bm25_sql(ASKED).replace('FROM documents', 'FROM docs')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM bm) SELECT query_id, node_id, rank, round(score, 5) AS score FROM r WHERE rank <= 30")
def upkept_index(spark, sf_dir):
    """An index of all documents that is brought up to date after some files changed."""
    folder = f"{sinks.working_folder(spark)}/upkept-{uuid.uuid4().hex}"
    key = F.col("node_id") % 40
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    before = d.withColumn("source_file", F.concat(F.lit("f"), key.cast("string")))
    own = vectors(spark, sf_dir).select("node_id", "embedding")
    engine.build(before, own, folder)
    longer = before.where(key != 0).withColumn("text", F.when(key == 1, F.concat("text", F.lit(" the there"))).otherwise(F.col("text")))
    copies = d.where(key == 2).select((F.col("node_id") + 1000000000).alias("node_id"), "text", F.lit("new").alias("source_file"))
    engine.refresh(longer.unionByName(copies), own, folder)
    return R.top_k(engine.scores_of(engine.load(spark, folder).keyword, _terms(spark, ASKED)), 30).select("query_id", "node_id", "rank", F.round("score", 5).alias("score"))


def _two_lists(spark, sf_dir):
    # a node among the first 30 by its best score is among the first 30 of the query that gives it
    v = R.best_per_node(_nearest(spark, sf_dir).where("score > 0")).withColumn("q", F.lit(0))
    b = R.best_per_node(_bm25(spark, sf_dir, MULTI)).withColumn("q", F.lit(0))
    return R.top_k(v, 30, "q"), R.top_k(b, 30, "q")


_LISTS = f"""{_COS}, {_bm25_sql(MULTI)},
v0 AS (SELECT node_id, max(score) AS score FROM cs WHERE score > 0 GROUP BY node_id),
v AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM v0) WHERE rank <= 30),
b0 AS (SELECT node_id, max(score) AS score FROM bm GROUP BY node_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM b0) WHERE rank <= 30)"""
_FUSED = "0.5 * coalesce(61.0::DOUBLE / (60 + v.rank), 0) + 0.3 * coalesce(61.0::DOUBLE / (60 + b.rank), 0)"


@query(f"WITH {_LISTS} SELECT node_id, CASE WHEN v.rank IS NULL THEN 'bm25' WHEN b.rank IS NULL THEN 'vector' ELSE 'both' END AS source, round({_FUSED}, 6) AS final_score FROM v FULL OUTER JOIN b USING (node_id)")
def rrf_fusion(spark, sf_dir):
    return R.fuse(*_two_lists(spark, sf_dir)).select("node_id", "source", F.round("final_score", 6).alias("final_score"))


FLT = M.Filters({"dept_short": ["en"], "grade": ["大二"], "teacher": ["src3教授"]})
SOFT = M.Filters({"dept_short": ["en"], "required_or_elective": ["必修"], "day_of_week": ["星期二"], "classroom": ["E10"]})
_SOFT_SQL = "CASE WHEN contains(classroom, 'E10') THEN 5.0 ELSE -3.0 END + CASE WHEN contains(required_or_elective, '必修') THEN 3.0 ELSE -2.0 END + CASE WHEN contains(CASE WHEN schedule <> '' THEN schedule ELSE text END, '星期二') THEN 2.0 ELSE -100.0 END"


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, ({_SOFT_SQL})::DOUBLE AS soft_score FROM c")
def soft_metadata_score(spark, sf_dir):
    """The classroom filter lifts the department filter."""
    return chunks(spark, sf_dir).select("node_id", M.soft_score(SOFT).alias("soft_score"))


NORMAL = M.Filters({"dept_short": ["en"], "grade": ["1"], "teacher": ["src1"], "ge_domain": ["人文"], "day_of_week": ["er"]})
_NORMAL_SQL = """(CASE WHEN contains(dept_short, 'en') OR contains('en', dept_short) THEN 0.3 ELSE 0 END + CASE WHEN grade = '一' THEN 0.25 ELSE 0 END
 + CASE WHEN contains(teacher, 'src1') OR (length(teacher) >= 2 AND (CASE WHEN contains(teacher, 's') THEN 1 ELSE 0 END + CASE WHEN contains(teacher, 'r') THEN 1 ELSE 0 END + CASE WHEN contains(teacher, 'c') THEN 1 ELSE 0 END + CASE WHEN contains(teacher, '1') THEN 1 ELSE 0 END) >= 2) THEN 0.2 ELSE 0 END
 + CASE WHEN ge_domain <> '' AND (contains(ge_domain, '人文') OR contains('人文', ge_domain)) THEN 0.3 ELSE 0 END + CASE WHEN contains(text, 'er') THEN 0.3 ELSE 0 END
 + CASE WHEN section IN ('basic_info', 'grading') THEN 0.2 ELSE 0 END)::DOUBLE / 1.55::DOUBLE"""


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, round({_NORMAL_SQL}, 6) AS metadata_score FROM c")
def norm_metadata_score(spark, sf_dir):
    return chunks(spark, sf_dir).select("node_id", F.round(M.normal_score(NORMAL, ["basic_info", "grading"]), 6).alias("metadata_score"))


MATRIX = {
    "dept_short": ["en", "de"], "course_name_keyword": ["Course7"], "teacher": ["src12老師"], "day_of_week": ["星期三"], "grade": ["大3"], "required_or_elective": ["選"],
    "time_period": ["3-4"], "semester": ["2"], "academic_year": ["113"], "class_group": ["甲"], "is_evening": ["True"], "classroom": ["11"], "ge_domain": ["自然科學"],
}


def _shared_sql(value: str, column: str) -> str:
    return f"(length({column}) >= 2 AND (" + " + ".join(f"CASE WHEN contains({column}, '{c}') THEN 1 ELSE 0 END" for c in value) + f") >= {max(2, int(0.67 * len(value)))})"


_PERIOD_SQL = "regexp_extract(schedule, '第(\\d+)節', 1) <> '' AND NOT (try_cast(regexp_extract(schedule, '第(\\d+)節', 1) AS int) > 4 OR try_cast(regexp_extract(schedule, '第\\d+節~第(\\d+)節', 1) AS int) < 3)"


@query(f"""WITH c AS ({CHUNKS_SQL}) SELECT node_id, contains(dept_short, 'en') OR contains('en', dept_short) OR contains(dept_short, 'de') OR contains('de', dept_short) AS dept_short,
 contains(course_name, 'course7') AS course_name_keyword, contains(teacher, 'src12') OR {_shared_sql('src12', 'teacher')} AS teacher, contains(CASE WHEN schedule <> '' THEN schedule ELSE text END, '星期三') AS day_of_week,
 grade = '三' AS grade, contains(required_or_elective, '選') AS required_or_elective, coalesce({_PERIOD_SQL}, false) AS time_period, semester = '2' AS semester, academic_year = '113' AS academic_year,
 class_group = '甲' AS class_group, is_evening, contains(classroom, '11') AS classroom, ge_domain <> '' AND (contains(ge_domain, '自然科學') OR contains('自然科學', ge_domain)) AS ge_domain FROM c""")
def matcher_matrix(spark, sf_dir):
    return chunks(spark, sf_dir).select("node_id", *[M.PREDICATES[k](v).alias(k) for k, v in MATRIX.items()])


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, schedule FROM c WHERE {_PERIOD_SQL}")
def period_overlap(spark, sf_dir):
    return chunks(spark, sf_dir).where(M.periods(["3-4"])).select("node_id", "schedule")


@query(f"SELECT s_suppkey, s_name, contains(lower(s_name), 'supplier#000000012') OR (s_name <> '' AND contains('supplier#000000012', lower(s_name))) OR {_shared_sql('supplier#000000012', 'lower(s_name)')} AS fuzzy FROM supplier")
def fuzzy_name_match(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", M.person("Supplier#000000012", F.col("s_name")).alias("fuzzy"))


def _scored(spark, sf_dir):
    """Chunks with the keyword score of one query."""
    return chunks(spark, sf_dir).join(R.best_per_node(_bm25(spark, sf_dir, MULTI)), "node_id")


_SCORED = f"{_bm25_sql(MULTI)}, one AS (SELECT node_id, max(score) AS score FROM bm GROUP BY node_id), c AS ({CHUNKS_SQL}), s AS (SELECT c.*, score FROM c JOIN one USING (node_id))"


@query(f"WITH {_SCORED} SELECT node_id, round(score, 5) AS final_score FROM s WHERE score >= 0.25 * (SELECT max(score) FROM s)")
def relative_threshold(spark, sf_dir):
    s = _scored(spark, sf_dir).select("node_id", F.col("score").alias("final_score"), F.lit(0.0).alias("metadata_score"))
    return R.relative_threshold(s, courses=0).select("node_id", F.round("final_score", 5).alias("final_score"))


@query(f"""WITH {_SCORED} SELECT node_id, round(0.75 / (1 + exp(-score / (1 + score))) + 0.25 * CASE WHEN contains(dept_short, 'en') OR contains('en', dept_short) THEN 1.0 ELSE 0.0 END
 + CASE WHEN section = 'basic_info' THEN 0.1 ELSE 0 END + CASE WHEN section IN ('objectives', 'syllabus') THEN 0.2 ELSE 0 END + CASE WHEN info_type = 'professor_info' THEN 0.5 ELSE 0 END, 6) AS rerank_score FROM s""")
def rerank_blend(spark, sf_dir):
    s = _scored(spark, sf_dir)
    cross = F.col("score") / (1 + F.col("score"))
    meta = M.normal_score(M.Filters({"dept_short": ["en"]}))
    boost = R.contextual_boost(F.col("section"), F.col("info_type"), "professor_info", {"research", "time"})
    return s.select("node_id", F.round(R.rerank_blend(cross, meta) + boost, 6).alias("rerank_score"))


@query(f"WITH {_SCORED} SELECT node_id, course_name, section, source_file FROM (SELECT *, first_value(source_file) OVER (PARTITION BY course_name, section, teacher, academic_year, semester ORDER BY score DESC, node_id) AS ff FROM s) WHERE source_file = ff")
def dedup_first_file(spark, sf_dir):
    return R.first_file(_scored(spark, sf_dir)).select("node_id", "course_name", "section", "source_file")


_COVER = "row_number() OVER (PARTITION BY course_name ORDER BY CASE WHEN section IN ('basic_info', 'syllabus') THEN 0 ELSE 1 END, score DESC, node_id)"


@query(f"""WITH {_SCORED}, g AS (SELECT *, {_COVER} = 1 AS guaranteed FROM s), r AS (SELECT *, row_number() OVER (ORDER BY guaranteed DESC, score DESC, node_id) AS n FROM g)
SELECT node_id, course_name, guaranteed, round(score, 5) AS score FROM r WHERE n <= greatest(10, (SELECT count(*) FROM g WHERE guaranteed) + 5)""")
def coverage_topn(spark, sf_dir):
    return R.covered_top(_scored(spark, sf_dir), 10).select("node_id", "course_name", "guaranteed", F.round("score", 5).alias("score"))


@query(f"WITH {_LISTS}, c AS ({CHUNKS_SQL}), f AS (SELECT node_id FROM v UNION SELECT node_id FROM b) SELECT node_id, 0.001::DOUBLE AS vector_score, 'metadata_inject' AS source FROM c WHERE section = 'basic_info' AND contains(teacher, 'src1') AND semester = '1' AND node_id NOT IN (SELECT node_id FROM f)")
def metadata_injection(spark, sf_dir):
    v, b = _two_lists(spark, sf_dir)
    found = v.select("node_id").union(b.select("node_id")).distinct()
    c = chunks(spark, sf_dir).where((F.col("section") == "basic_info") & F.col("teacher").contains("src1") & M.PREDICATES["semester"](["1"]))
    return c.join(found, "node_id", "left_anti").select("node_id", F.lit(0.001).alias("vector_score"), F.lit("metadata_inject").alias("source"))


@query(f"""WITH {_LISTS}, c AS ({CHUNKS_SQL}), f AS (SELECT node_id, {_FUSED} AS final_score, CASE WHEN v.rank IS NULL THEN 'bm25' WHEN b.rank IS NULL THEN 'vector' ELSE 'both' END AS source FROM v FULL OUTER JOIN b USING (node_id)),
x AS (SELECT node_id, 5.0::DOUBLE AS m FROM c WHERE info_type = 'professor_info')
SELECT node_id, round(coalesce(final_score, 0), 6) AS final_score, coalesce(greatest(CASE WHEN f.node_id IS NOT NULL THEN 0.0::DOUBLE ELSE m END, m), CASE WHEN f.node_id IS NOT NULL THEN 0.0::DOUBLE END) AS metadata_score, CASE WHEN m IS NOT NULL THEN 'intent_inject' ELSE source END AS source FROM f FULL OUTER JOIN x USING (node_id)""".replace("f.node_id IS NOT NULL", "f.source IS NOT NULL"))
def intent_injection(spark, sf_dir):
    found = R.fuse(*_two_lists(spark, sf_dir))
    more = chunks(spark, sf_dir).where("info_type = 'professor_info'").select("node_id", F.lit(5.0).alias("metadata_score"))
    return R.inject(found, more).select("node_id", F.round("final_score", 6).alias("final_score"), "metadata_score", "source")


@query(f"WITH {_SCORED} SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 50")
def global_rank(spark, sf_dir):
    return R.top_k(_scored(spark, sf_dir).withColumn("q", F.lit(0)), 50, "q").select("node_id", "rank")


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 50) SELECT course_name, section, min(rank) AS rank FROM k GROUP BY ALL")
def citation_list(spark, sf_dir):
    top = R.top_k(_scored(spark, sf_dir).withColumn("q", F.lit(0)), 50, "q")
    return R.citations(top).select("course_name", "section", "rank")


@query("""WITH a AS (SELECT vec_id AS node_id, 'course' AS kind FROM embeddings WHERE label < 4 UNION ALL SELECT vec_id, 'professor' FROM embeddings WHERE label BETWEEN 4 AND 6 UNION ALL SELECT vec_id, 'rule' FROM embeddings WHERE label > 6)
SELECT node_id, kind, doc_id IS NOT NULL AS has_text FROM a LEFT JOIN documents ON node_id = doc_id""")
def position_join(spark, sf_dir):
    """Union of three node families, joined to texts by id, never by position."""
    e = vectors(spark, sf_dir)
    family = lambda cond, kind: e.where(cond).select("node_id", F.lit(kind).alias("kind"))
    nodes = family("label < 4", "course").unionByName(family("label BETWEEN 4 AND 6", "professor")).unionByName(family("label > 6", "rule"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.lit(True).alias("has_text"))
    return nodes.join(texts, "node_id", "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT course_name, dept_short FROM (SELECT DISTINCT course_name, dept_short FROM c WHERE dept_short <> 'en' AND academic_year = '114') ORDER BY md5('7:' || course_name || dept_short), course_name || dept_short LIMIT 15")
def seeded_sample(spark, sf_dir):
    pairs = chunks(spark, sf_dir).where("dept_short <> 'en' AND academic_year = '114'").select("course_name", "dept_short").distinct()
    return R.seeded_sample(pairs.withColumn("k", F.concat("course_name", "dept_short")), "k", 15, seed=7).select("course_name", "dept_short")


_HYBRID = M.Filters({"dept_short": ["en"]})


def hybrid_plan(spark, sf_dir, top_k: int = 30):
    """Vector and keyword lists fused with metadata scores, best first."""
    v, b = _two_lists(spark, sf_dir)
    v, b = sinks.kept(v, "near"), sinks.kept(b, "found")  # two lists of 30 rows; the filter on the metadata and the fusion both read them
    listed = F.broadcast(v.select("node_id").union(b.select("node_id")).distinct())
    meta = chunks(spark, sf_dir).select("node_id", (M.normal_score(_HYBRID) + M.soft_score(_HYBRID)).alias("metadata_score"))
    return R.fuse(v, b, meta.join(listed, "node_id", "left_semi")).orderBy(F.desc("final_score"), "node_id").limit(top_k)


@query(f"""WITH {_LISTS}, c AS ({CHUNKS_SQL}), m AS (SELECT node_id, CASE WHEN contains(dept_short, 'en') OR contains('en', dept_short) THEN 3.0::DOUBLE ELSE -100.0::DOUBLE END AS meta FROM c),
f AS (SELECT node_id, {_FUSED} + 0.2 * coalesce(meta, 0) AS s, coalesce(meta, 0.0::DOUBLE) AS meta, CASE WHEN v.rank IS NULL THEN 'bm25' WHEN b.rank IS NULL THEN 'vector' ELSE 'both' END AS source FROM v FULL OUTER JOIN b USING (node_id) LEFT JOIN m USING (node_id))
SELECT node_id, source, round(meta, 6) AS metadata_score, round(s, 6) AS final_score FROM f ORDER BY s DESC, node_id LIMIT 30""")
def hybrid_topk(spark, sf_dir):
    return hybrid_plan(spark, sf_dir).select("node_id", "source", F.round("metadata_score", 6).alias("metadata_score"), F.round("final_score", 6).alias("final_score"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 1 AND t NOT IN ('之','於'))) AS n_query_tokens, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_tokens FROM documents")
def tokenise_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.query_tokens(F.col("text"))).cast("long").alias("n_query_tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.SECTION_LABELS.items())


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, CASE section {_LABELS} ELSE section END AS label, md5(concat('[', course_name, '] ', teacher, ' ', schedule, chr(10), text)) AS headed FROM c")
def section_labels(spark, sf_dir):
    """Display labels, and the header line that is put before a chunk's text."""
    from itertools import chain

    labels = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in lexicon.SECTION_LABELS.items()))
    c = chunks(spark, sf_dir)
    return c.select("node_id", F.coalesce(F.try_element_at(labels, F.col("section")), F.col("section")).alias("label"), F.md5(I.headed()).alias("headed"))


@query(f"""WITH c AS ({CHUNKS_SQL}), t AS (SELECT 'teacher' AS kind, teacher AS key, node_id FROM c WHERE section = 'basic_info' UNION ALL SELECT 'classroom', classroom, node_id FROM c WHERE section = 'basic_info' UNION ALL SELECT 'course', lower(course_name), node_id FROM c WHERE section = 'basic_info')
SELECT kind, key, count(*) AS n_nodes, min(node_id) AS first_node FROM t GROUP BY ALL""")
def metadata_registry(spark, sf_dir):
    return I.registry(chunks(spark, sf_dir)).groupBy("kind", "key").agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("first_node"))


@query("SELECT DISTINCT name FROM (SELECT trim(unnest(regexp_split_to_array(p_type, '[、,，/ ]'))) AS name FROM part UNION ALL SELECT trim(regexp_replace(p_name, '[（(][^）)]*[）)]', '', 'g')) FROM part UNION ALL SELECT p_name FROM part) WHERE length(name) >= 2")
def known_entities(spark, sf_dir):
    return I.known_names(table(spark, sf_dir, "part"), "p_type", "p_name")


@query(f"WITH c AS ({CHUNKS_SQL}), t AS (SELECT DISTINCT course_name, teacher FROM c WHERE section = 'basic_info'), p AS (SELECT teacher, min(node_id) AS profile FROM c WHERE info_type = 'professor_info' GROUP BY teacher) SELECT course_name, teacher, profile FROM t JOIN p USING (teacher)")
def course_to_professor(spark, sf_dir):
    return I.profiles(chunks(spark, sf_dir))


@query(f"WITH {_LISTS}, c AS ({CHUNKS_SQL}) SELECT node_id, teacher FROM c WHERE teacher IN ('src1', 'src2') AND node_id NOT IN (SELECT node_id FROM v UNION SELECT node_id FROM b)")
def professor_backfill(spark, sf_dir):
    v, b = _two_lists(spark, sf_dir)
    seen = v.select("node_id").union(b.select("node_id"))
    return I.chunks_of(chunks(spark, sf_dir), seen, ["src1", "src2"]).select("node_id", "teacher")


@query(f"""WITH {_LISTS}, c AS ({CHUNKS_SQL}), x AS (SELECT * FROM c WHERE info_type = 'professor_info' AND node_id NOT IN (SELECT node_id FROM v UNION SELECT node_id FROM b))
SELECT 'named' AS asked, node_id, 10.0::DOUBLE AS metadata_score, 'context_backfill' AS source FROM x WHERE contains(teacher, 'src1') UNION ALL SELECT 'all', node_id, 5.0, 'general_prof_backfill' FROM x WHERE teacher <> ''""")
def evidence_backfill(spark, sf_dir):
    """What the lists lack of one professor, and of all."""
    v, b = _two_lists(spark, sf_dir)
    seen = sinks.kept(v.select("node_id").union(b.select("node_id")), "seen")
    c = chunks(spark, sf_dir)
    parts = [I.backfill(c, seen, name).withColumn("asked", F.lit(asked)) for asked, name in (("named", "src1"), ("all", None))]
    return parts[0].unionByName(parts[1]).drop("score")


@query(f"WITH c AS ({CHUNKS_SQL}), d AS (SELECT DISTINCT teacher, course_name FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY teacher ORDER BY course_name) AS n FROM d) SELECT teacher, course_name FROM r WHERE n <= 25")
def teacher_courses(spark, sf_dir):
    return I.courses_of(chunks(spark, sf_dir))


@query("""WITH c AS (SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100),
l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, pos) AS n FROM l WHERE line <> '')
SELECT source, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY doc_id, pos)) AS dossier FROM f WHERE n = 1 GROUP BY source""")
def professor_dossier(spark, sf_dir):
    """Each teacher's first 100 chunks (the dossier's limit) as one text in which a line occurs once."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").withColumn("n", n).where(F.col("n") <= 100)
    lines = d.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line")).where("line <> ''")
    once = lines.withColumn("n", F.row_number().over(Window.partitionBy("source", "line").orderBy("doc_id", "pos"))).where("n = 1")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "pos", "line")))
    return once.groupBy("source").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("dossier"))


_STRICT = M.Filters({"classroom": ["E110"], "academic_year": ["113"]})
_STRICT_SQL = "section = 'basic_info' AND (contains(lower(classroom), 'e110') OR contains('e110', lower(classroom))) AND contains(classroom, 'E110') AND academic_year = '113'"


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, classroom FROM c WHERE {_STRICT_SQL}")
def metadata_first(spark, sf_dir):
    """Chunks that satisfy all strict filters, found without any search list."""
    c = chunks(spark, sf_dir)
    return c.join(I.by_metadata(c, _STRICT), "node_id", "left_semi").select("node_id", "classroom")


_KINDS = ", ".join(f"'{k}'" for k in I.POLICY_KINDS)


@query(f"""WITH c AS ({CHUNKS_SQL}) SELECT 'named' AS asked, node_id, 1.0::DOUBLE AS score, 10.0::DOUBLE AS metadata_score, 'intent_inject_exact' AS source FROM c WHERE info_type = 'professor_info' AND teacher IN ('src1') UNION ALL
SELECT 'named', node_id, 0.5, 5.0, 'intent_inject' FROM c WHERE info_type = 'dept_intro' AND dept_short <> '' UNION ALL
SELECT 'all', node_id, CASE WHEN info_type = 'professor_info' THEN 0.9 ELSE 0.5 END, 5.0, CASE WHEN info_type = 'professor_info' THEN 'intent_inject_all_profs' ELSE 'intent_inject' END FROM c WHERE info_type = 'professor_info' OR info_type = 'dept_intro' AND dept_short <> '' UNION ALL
SELECT 'policy', node_id, 1.0, 10.0, 'intent_inject_policy' FROM c WHERE info_type IN ({_KINDS})""".replace("teacher IN ('src1')", f"(contains(teacher, 'src1') OR contains('src1', teacher) OR {_shared_sql('src1', 'teacher')})"))
def intent_rows(spark, sf_dir):
    """What a question about a professor, about professors and about rules always sees."""
    c = chunks(spark, sf_dir)
    asked = {"named": I.by_intent(c, "professor_info", ["src1教授"]), "all": I.by_intent(c, "professor_info"), "policy": I.by_intent(c, "policy_rules")}
    parts = [rows.withColumn("asked", F.lit(name)) for name, rows in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH c AS ({CHUNKS_SQL}), t AS (SELECT *, section IN ('basic_info', 'objectives') AND academic_year = '114' AND semester = '2' AS term, contains('fr', dept_short) OR contains(dept_short, 'fr') AS own FROM c),
p AS (SELECT course_name, dept_short FROM (SELECT DISTINCT course_name, dept_short FROM t WHERE term AND NOT own) ORDER BY md5('7:' || course_name || dept_short), course_name || dept_short LIMIT 15)
SELECT node_id, 10.0::DOUBLE AS metadata_score, 'full_curriculum_scan' AS source FROM t WHERE term AND own UNION ALL SELECT node_id, 15.0, 'full_curriculum_scan' FROM t WHERE own AND NOT term AND info_type IN ('career_info', 'dept_intro')
UNION ALL SELECT node_id, 10.0, 'full_curriculum_scan' FROM t JOIN p USING (course_name, dept_short) WHERE term AND NOT own""")
def curriculum_scan(spark, sf_dir):
    return I.curriculum(chunks(spark, sf_dir), "fr", "114", "2")


#: A question's vectors are those of its few rewritings.
_OWN_COS = _COS.replace("vec_id % 100 = 0", "vec_id IN (0, 1, 2)")
_TOP_LISTS = f"""{_OWN_COS}, {_bm25_sql(MULTI)},
v1 AS (SELECT query_id, node_id, score FROM cs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 30),
v2 AS (SELECT node_id, max(score) AS score FROM v1 GROUP BY node_id),
b1 AS (SELECT query_id, node_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 30),
b2 AS (SELECT node_id, max(score) AS score FROM b1 GROUP BY node_id),
b AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM b2 QUALIFY rank <= 90)"""
#: A vector without a chunk has no metadata score.
_SOFT_STRICT = "CASE WHEN classroom IS NULL THEN 0.0 ELSE CASE WHEN contains(classroom, 'E110') THEN 5.0 ELSE -3.0 END + CASE WHEN academic_year = '113' THEN 2.0 ELSE -100.0 END END"


@query(f"""WITH {_TOP_LISTS}, c AS ({CHUNKS_SQL}),
v3 AS (SELECT * FROM v2 UNION ALL SELECT node_id, 0.001 FROM c WHERE {_STRICT_SQL} AND node_id NOT IN (SELECT node_id FROM v2 UNION SELECT node_id FROM b)),
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM v3),
f AS (SELECT node_id, coalesce(b.score, 0) AS bm25, ({_SOFT_STRICT})::DOUBLE AS meta, {_FUSED} + 0.2 * coalesce(({_SOFT_STRICT})::DOUBLE, 0) AS final FROM v FULL OUTER JOIN b USING (node_id) LEFT JOIN c USING (node_id)),
s AS (SELECT node_id, bm25, coalesce(meta, 0) AS meta FROM f ORDER BY final DESC, node_id LIMIT 30),
x AS (SELECT node_id, 5.0::DOUBLE AS extra FROM c WHERE info_type = 'professor_info' OR info_type = 'dept_intro' AND dept_short <> ''),
m AS (SELECT node_id, coalesce(bm25, 0) AS bm25, greatest(coalesce(meta, extra), coalesce(extra, meta)) AS meta FROM s FULL OUTER JOIN x USING (node_id)),
r AS (SELECT c.*, 0.75 / (1 + exp(-bm25 / (1 + bm25))) + 0.25 * meta + CASE WHEN info_type = 'professor_info' THEN 0.5 ELSE 0 END AS score FROM c JOIN m USING (node_id)),
o AS (SELECT * FROM r QUALIFY source_file = first_value(source_file) OVER (PARTITION BY course_name, section, teacher, academic_year, semester ORDER BY score DESC, node_id))
SELECT node_id, round(score, 6) AS score FROM o WHERE score >= 0.25 * (SELECT max(score) FROM o) ORDER BY score DESC, node_id LIMIT 25""")
def question_evidence(spark, sf_dir):
    """A routed question from search to the rows that its answer rests on."""
    terms = _terms(spark, MULTI)
    index = engine.in_memory(chunks(spark, sf_dir), vectors(spark, sf_dir).select("node_id", "embedding"), sorted({w for words in MULTI.values() for w in words}))
    rows = engine.evidence(index, Route("professor_info", _STRICT), terms, query_vectors(spark, sf_dir))
    return rows.select("node_id", F.round("score", 6).alias("score"))
