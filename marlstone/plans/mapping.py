"""The driver tables seen as the engine's entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ["basic_info", "objectives", "syllabus", "textbooks", "schedule_table", "grading"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions that both engines understand, by chunk column.
_COLUMNS = {
    "node_id": "d.doc_id",
    "text": "d.text",
    "course_name": "concat('course', cast(d.doc_id % 50 as string))",
    "dept_short": "d.lang",
    "teacher": "d.source",
    "section": "case d.doc_id % 6 when 0 then 'basic_info' when 1 then 'objectives' when 2 then 'syllabus' when 3 then 'textbooks' when 4 then 'schedule_table' else 'grading' end",
    "source_file": "concat('f', cast(d.doc_id % 3 as string))",
    "required_or_elective": "case when l.quality = 1 then '必修' when l.quality = 0 then '選修' else '' end",
    "is_evening": "coalesce(l.toxic = 1, false)",
    "grade": "case d.doc_id % 4 when 0 then '一' when 1 then '二' when 2 then '三' else '四' end",
    "class_group": "case d.doc_id % 2 when 0 then '甲' else '乙' end",
    "academic_year": "case when d.doc_id % 3 = 0 then '113' else '114' end",
    "semester": "cast(d.doc_id % 2 + 1 as string)",
    "schedule": "case when d.doc_id % 11 = 0 then '' else concat('星期', substr('一二三四五', cast(d.doc_id % 5 + 1 as int), 1), '第', cast(d.doc_id % 10 + 1 as string), '節~第', cast(d.doc_id % 10 + 1 + d.doc_id % 3 as string), '節') end",
    "classroom": "concat('E', cast(100 + d.doc_id % 20 as string))",
    "ge_domain": "case d.doc_id % 4 when 0 then '人文' when 1 then '社會' when 2 then '自然' else '' end",
    "info_type": "case d.doc_id % 7 when 3 then 'professor_info' when 5 then 'dept_intro' when 6 then 'policy_rules' end",
    "credits": "case when d.doc_id % 13 = 0 then 'x' else concat(cast(d.doc_id % 4 as string), '.0') end",
}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    joined = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return joined.select(*[F.expr(e).alias(c) for c, e in _COLUMNS.items()])


CHUNKS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (0, 1, 2)) -> list[tuple[int, list[float]]]:
    """The first vectors serve as queries."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).orderBy("vec_id").collect()
    return [(int(r.vec_id), [float(x) for x in r.embedding]) for r in rows]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar rows: title, start, end (timestamps; the end is ``value`` minutes later)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", F.col("event_type").alias("title"), F.col("ts").alias("start"), "value", "props")


#: Credits by student: a lineitem is a course, its part the course's name and type, its order's half-year the term.
TRANSCRIPT = """
SELECT c.c_custkey AS student, c.c_nationkey AS dept, concat(cast(year(o.o_orderdate) as string), '-', case when month(o.o_orderdate) <= 6 then '1' else '2' end) AS term,
  o.o_orderkey AS orderkey, l.l_linenumber AS pos, p.p_name AS name,
  case when l.l_partkey % 3 = 0 then '必' when l.l_partkey % 3 = 1 then '選' else '通' end AS type,
  case l.l_returnflag when 'A' then '及格' when 'N' then '抵免' else case when l.l_linenumber % 3 = 0 then '不及格' when l.l_linenumber % 3 = 1 then '停修' else '修課中' end end AS status,
  cast(l.l_quantity as bigint) % 4 + 1 AS credits, l.l_linestatus AS linestatus, cast(l.l_quantity as bigint) AS grade
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
"""


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A SQL plan over driver tables, bound by name without touching the session's catalogue."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TRANSCRIPT.replace("FROM customer c", "FROM {customer} c").replace("JOIN orders o", "JOIN {orders} o").replace("JOIN lineitem l", "JOIN {lineitem} l").replace("JOIN part p", "JOIN {part} p")
    return sql(spark, sf_dir, text, "customer", "orders", "lineitem", "part")


#: Class slots: each lineitem occupies a day and a period of its supplier's timetable.
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").alias("owner"), (F.col("l_linenumber") % 7 + 1).cast("int").alias("day"), (F.col("l_partkey") % 13 + 1).cast("int").alias("period"), F.col("l_partkey").alias("course"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("pos2"))


SLOTS_SQL = "SELECT l_suppkey AS owner, cast(l_linenumber % 7 + 1 AS int) AS day, cast(l_partkey % 13 + 1 AS int) AS period, l_partkey AS course, l_orderkey AS pos, l_linenumber AS pos2 FROM lineitem"
