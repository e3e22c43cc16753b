"""Rows that filters or a question's type put into the candidates, whatever the search lists hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import match as M
from . import retrieve as R

#: Kinds of chunk that a question about rules always sees.
POLICY_KINDS = ("graduation_rules", "policy", "policy_rules", "dept_intro", "career_info", "student_union", "dept_news", "dept_general")
#: Keys that a chunk must satisfy to be injected by its metadata.
STRICT = ("dept_short", "grade", "teacher", "classroom", "course_name_keyword", "academic_year", "semester", "day_of_week")


def _either(column: str, values: list[str]) -> Column:
    own = F.lower(column)
    return reduce(lambda a, b: a | b, [own.contains(v.lower()) | F.lit(v.lower()).contains(own) for v in values])


def by_metadata(chunks: DataFrame, filters: M.Filters) -> DataFrame:
    """node_id of basic_info chunks that satisfy every strict filter.

    It needs a teacher, classroom or course, or both a department and a grade; the first of teacher, classroom,
    course and department that is wanted also has to be found in the registry's looser way.
    """
    w = {k: v for k, v in filters.wanted.items() if v}
    if not ({"teacher", "classroom", "course_name_keyword"} & w.keys() or {"dept_short", "grade"} <= w.keys()):
        return chunks.select("node_id").limit(0)
    if "teacher" in w:
        names = [v.removesuffix("老師").removesuffix("教授") for v in w["teacher"]]
        registered = reduce(lambda a, b: a | b, [M.person(n, F.col("teacher")) for n in names])
    else:
        key, column = next((k, c) for k, c in (("classroom", "classroom"), ("course_name_keyword", "course_name"), ("dept_short", "dept_short")) if k in w)
        registered = _either(column, w[key])
    strict = reduce(lambda a, b: a & b, [M.PREDICATES[k](w[k]) for k in STRICT if k in w])
    return chunks.where((F.col("section") == "basic_info") & registered & strict).select("node_id")


def headed() -> Column:
    """A chunk's text under a line that says what it is of."""
    return F.concat(F.lit("["), "course_name", F.lit("] "), "teacher", F.lit(" "), "schedule", F.lit("\n"), F.coalesce("text", F.lit("")))


def registry(chunks: DataFrame) -> DataFrame:
    """kind, key, node_id of the basic_info chunks: teachers (no titles) in lower case, classrooms, courses in lower case with and without their brackets."""
    basic = chunks.where("section = 'basic_info'")
    course = F.lower("course_name")
    keys = [("teacher", F.regexp_replace(F.lower("teacher"), "(?:老師|教授)$", "")), ("classroom", F.col("classroom")), ("course", course), ("course", F.trim(F.regexp_replace(course, "[（(][^）)]*[）)]", "")))]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys]))
    return basic.select(each.alias("k"), "node_id").select("k.kind", "k.key", "node_id").distinct()


def _scored(rows: DataFrame, score: float, metadata: float, source: str) -> DataFrame:
    return rows.select("node_id", F.lit(score).alias("score"), F.lit(metadata).alias("metadata_score"), F.lit(source).alias("source"))


def by_intent(chunks: DataFrame, query_type: str, teachers: list[str] | None = None) -> DataFrame:
    """node_id, score, metadata_score, source of the chunks that a type of question always sees: profiles of the professors
    named, or of all of them, with their departments' background; or every kind of rule."""
    names = [t.removesuffix("老師").removesuffix("教授") for t in teachers or [] if t]
    kind = F.col("info_type")
    background = F.coalesce("dept_short", F.lit("")) != ""
    if query_type == "professor_info" and names:
        named = reduce(lambda a, b: a | b, [M.person(n, F.col("teacher")) for n in names])
        profiles = _scored(chunks.where((kind == "professor_info") & named), 1.0, 10.0, "intent_inject_exact")
        return profiles.unionByName(_scored(chunks.where(kind.isin("dept_intro", "career_info") & background), 0.5, 5.0, "intent_inject"))
    if query_type == "professor_info":
        profiles = _scored(chunks.where(kind == "professor_info"), 0.9, 5.0, "intent_inject_all_profs")
        return profiles.unionByName(_scored(chunks.where(kind.isin("dept_intro", "career_info", "facility_info") & background), 0.5, 5.0, "intent_inject"))
    if query_type == "policy_rules":
        return _scored(chunks.where(kind.isin(*POLICY_KINDS)), 1.0, 10.0, "intent_inject_policy")
    return _scored(chunks.limit(0), 0.0, 0.0, "")


def curriculum(chunks: DataFrame, department: str | None, year: str, semester: str, most: int = 15, seed: int = 7) -> DataFrame:
    """Career planning: this term's courses and the background of the own department, and of the other departments a seeded
    sample of at most ``most`` courses; node_id, metadata_score, source."""
    bare = lambda c: reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), ("系所", "學系", "系"), F.replace(c, F.lit("資訊工程"), F.lit("資工")))
    own = F.lit(False)
    if department:
        mine, theirs = bare(F.lit(department)), bare(F.coalesce("dept_short", F.lit("未知系所")))
        own = mine.contains(theirs) | theirs.contains(mine)
    term = F.col("section").isin("basic_info", "objectives") & (F.col("academic_year") == year) & (F.col("semester") == semester) & F.col("course_name").isNotNull()
    scan = lambda rows, meta: _scored(rows, 1.0, meta, "full_curriculum_scan")
    courses = chunks.where(term)
    others = courses.where(~own)
    picked = R.seeded_sample(others.select("course_name", "dept_short").distinct().withColumn("__k", F.concat("course_name", "dept_short")), "__k", most, seed)
    sampled = others.join(F.broadcast(picked.select("course_name", "dept_short")), ["course_name", "dept_short"], "left_semi")  # at most ``most`` rows
    intro = chunks.where(own & F.col("info_type").isin("career_info", "dept_intro") & ~F.coalesce(term, F.lit(False)))
    return scan(courses.where(own), 10.0).unionByName(scan(intro, 15.0)).unionByName(scan(sampled, 10.0)).drop("score")


UNNAMED = "未知教授"


def backfill(chunks: DataFrame, found: DataFrame, teacher: str | None = None) -> DataFrame:
    """node_id, score, metadata_score, source of what a question about professors lacks in its evidence (found: node_id): all chunks of the professor
    named, by a part of the name; without one those of every professor who has a name, with the descriptions of rooms and equipment."""
    kind, name = F.col("info_type"), F.coalesce("teacher", F.lit(""))
    lacking = chunks.join(found.select("node_id").distinct(), "node_id", "left_anti")
    if teacher:
        return _scored(lacking.where((kind == "professor_info") & name.contains(teacher)), 1.0, 10.0, "context_backfill")
    professors = _scored(lacking.where((kind == "professor_info") & ~name.isin("", UNNAMED)), 1.0, 5.0, "general_prof_backfill")
    return professors.unionByName(_scored(lacking.where(kind == "facility_info"), 1.0, 5.0, "general_facility_backfill"))


def chunks_of(chunks: DataFrame, found: DataFrame, teachers: list[str]) -> DataFrame:
    """Chunks of teachers of these very names that the evidence lacks."""
    return chunks.where(F.col("teacher").isin(*teachers)).join(found.select("node_id").distinct(), "node_id", "left_anti")


def profiles(chunks: DataFrame) -> DataFrame:
    """course_name, teacher, profile: each course's teacher with the first chunk of their profile."""
    taught = chunks.where("section = 'basic_info'").select("course_name", "teacher").distinct()
    first = chunks.where("info_type = 'professor_info'").groupBy("teacher").agg(F.min("node_id").alias("profile"))
    return taught.join(first, "teacher").select("course_name", "teacher", "profile")


def courses_of(chunks: DataFrame, most: int = 25) -> DataFrame:
    """teacher, course_name: the first ``most`` courses by name of each teacher; a course with several teachers counts for each."""
    pairs = chunks.select(F.explode(F.split("teacher", "[、,，/]")).alias("teacher"), "course_name").distinct()
    n = F.row_number().over(Window.partitionBy("teacher").orderBy("course_name"))
    return pairs.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def known_names(rows: DataFrame, teachers: str, course: str, least: int = 2) -> DataFrame:
    """name: every teacher of a joined list, and every course with and without what stands in brackets; shorter names are left out."""
    people = rows.select(F.explode(F.split(teachers, "[、,，/ ]")).alias("name")).select(F.trim("name").alias("name"))
    titles = rows.select(F.explode(F.array(T.strip_parens(F.col(course)), F.col(course))).alias("name"))
    return people.union(titles).where(F.length("name") >= least).distinct()
