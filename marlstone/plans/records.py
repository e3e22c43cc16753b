"""Queries of personal records, groups, manifests and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import match as M
from ..operators import records as R
from ..operators.retrieve import numbered
from .mapping import CHUNKS_SQL, SLOTS_SQL, TRANSCRIPT, chunks, slots, table, transcript

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


T = f"t AS ({TRANSCRIPT})"
_OWN = "EXISTS (SELECT 1 FROM rules r WHERE r.dept = t.dept AND (contains(t.name, r.rule_course) OR contains(r.rule_course, t.name)))"
_RULES = "rules AS (SELECT DISTINCT n_nationkey AS dept, p_name AS rule_course FROM nation JOIN part ON p_partkey % 25 = n_nationkey)"


def _rules(spark, sf_dir):
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    return p.join(n, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("n_nationkey").alias("dept"), F.col("p_name").alias("rule_course")).distinct()


@query(f"""WITH {T}, {_RULES}, o AS (SELECT t.*, {_OWN} AS own FROM t), k AS (SELECT *, CASE WHEN type = '必' AND NOT own THEN '選' ELSE type END AS kind FROM o WHERE status IN ('及格', '抵免'))
SELECT student, coalesce(sum(credits) FILTER (kind = '必'), 0)::BIGINT AS compulsory, coalesce(sum(credits) FILTER (kind = '選'), 0)::BIGINT AS elective, coalesce(sum(credits) FILTER (kind = '通'), 0)::BIGINT AS "general", sum(credits)::BIGINT AS earned, greatest(0, 130 - sum(credits))::BIGINT AS remaining FROM k GROUP BY student""")
def credit_audit(spark, sf_dir):
    return R.audit(R.own_required(transcript(spark, sf_dir), _rules(spark, sf_dir)))


@query("SELECT coalesce(nullif(sum(p_size) FILTER (p_partkey % 4 IN (0, 1, 2)), 0), 65)::BIGINT AS compulsory, 49 AS elective, 16 AS \"general\", 130 AS total FROM part")
def requirement_totals(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("共同必修", "院必修", "系必修", "其他")])
    p = table(spark, sf_dir, "part")
    return R.requirements(p.select(F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("category"), F.col("p_size").alias("credits")))


@query(f"WITH {T}, m AS (SELECT student, max(term) AS term FROM t GROUP BY student) SELECT student, term, sum(credits)::BIGINT AS credits FROM t JOIN m USING (student, term) WHERE status = '修課中' GROUP BY ALL")
def ongoing_credits(spark, sf_dir):
    return R.ongoing(transcript(spark, sf_dir))


@query(f"WITH {T} SELECT student, term, orderkey, pos, name, status FROM t WHERE status IN ('不及格', '停修', '未完成')")
def failed_courses(spark, sf_dir):
    return transcript(spark, sf_dir).where(F.col("status").isin(*R.FAILED)).select("student", "term", "orderkey", "pos", "name", "status")


@query(f"""WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY student, term ORDER BY orderkey, pos, name) AS i FROM t)
SELECT student, term, count(*) FILTER (status IN ('及格', '抵免')) AS passed, count(*) FILTER (status = '不及格') AS failed, count(*) FILTER (status = '停修') AS withdrawn, count(*) FILTER (status = '修課中') AS ongoing,
sum(credits)::BIGINT AS credits, string_agg(name, '|' ORDER BY i) FILTER (i <= 6) AS names FROM n GROUP BY student, term""")
def term_histogram(spark, sf_dir):
    return R.term_histogram(transcript(spark, sf_dir))


@query(f"WITH {T} SELECT student, term, count(*) AS n_courses, round(avg(grade), 4) AS gpa FROM t GROUP BY ALL")
def gpa_by_term(spark, sf_dir):
    return transcript(spark, sf_dir).groupBy("student", "term").agg(F.count("*").alias("n_courses"), F.round(F.avg("grade"), 4).alias("gpa"))


@query(f"WITH {T} SELECT student, type, count(*) AS n, sum(credits)::BIGINT AS credits FROM t GROUP BY ALL")
def credit_by_type(spark, sf_dir):
    return transcript(spark, sf_dir).groupBy("student", "type").agg(F.count("*").alias("n"), F.sum("credits").cast("long").alias("credits"))


@query(f"""WITH s AS ({SLOTS_SQL}), g AS (SELECT owner, d.day, p.period FROM (SELECT DISTINCT owner FROM s), (SELECT unnest(range(1, 8))::INT AS day) d, (SELECT unnest(range(1, 14))::INT AS period) p),
f AS (SELECT g.owner, g.day, g.period, x.owner IS NULL AS is_free FROM g LEFT JOIN (SELECT DISTINCT owner, day, period FROM s) x USING (owner, day, period))
SELECT owner, day, coalesce(string_agg(period, ',' ORDER BY period) FILTER (is_free), '') AS free, count(*) FILTER (is_free) AS n_free FROM f GROUP BY owner, day""".replace("x.owner IS NULL", "x.hit IS NULL").replace("(SELECT DISTINCT owner, day, period FROM s) x", "(SELECT DISTINCT owner, day, period, 1 AS hit FROM s) x"))
def timetable_free_slots(spark, sf_dir):
    return R.free_slots(slots(spark, sf_dir))


_PERIOD_VALUES = ", ".join(f"({n}, '{a}', '{b}')" for n, a, b in lexicon.PERIODS)


@query(f"""WITH s AS ({SLOTS_SQL}), w AS (SELECT owner, day, period, arg_max(course, (pos, pos2, course)) AS course FROM s GROUP BY ALL), r AS (SELECT owner, day, course, min(period) AS first, max(period) AS last FROM w GROUP BY ALL),
p AS (SELECT * FROM (VALUES {_PERIOD_VALUES}) v(period, starts, ends)) SELECT owner, day, course, first, last, a.starts, b.ends FROM r JOIN p a ON a.period = first JOIN p b ON b.period = last""")
def day_schedule(spark, sf_dir):
    periods = spark.createDataFrame(lexicon.PERIODS, "period int, starts string, ends string")
    return R.day_schedule(slots(spark, sf_dir), periods)


@query(f"WITH s AS ({SLOTS_SQL}), r AS (SELECT owner, day, min(period) AS first, max(period) AS last FROM s GROUP BY ALL), p AS (SELECT * FROM (VALUES {_PERIOD_VALUES}) v(period, starts, ends)) SELECT owner, day, a.starts || '-' || b.ends AS clock FROM r JOIN p a ON a.period = first JOIN p b ON b.period = last")
def slot_to_clock(spark, sf_dir):
    periods = spark.createDataFrame(lexicon.PERIODS, "period int, starts string, ends string")
    whole = slots(spark, sf_dir).withColumn("course", F.lit(0).cast("long"))
    return R.day_schedule(whole, periods).select("owner", "day", F.concat("starts", F.lit("-"), "ends").alias("clock"))


_ENRICH = """
c AS (SELECT p_name AS c_name, p_brand AS c_teacher, p_size % 4 AS credits, CASE WHEN p_partkey % 2 = 0 THEN '選修' ELSE '' END AS type FROM part WHERE p_size <= 10),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' II' ELSE p_name END AS name, p_brand AS teacher FROM part),
x AS (SELECT *, 1 AS tier FROM r JOIN c ON name = c_name UNION ALL SELECT *, 2 FROM r JOIN c ON name <> c_name AND length(name) >= 3 AND length(c_name) >= 3 AND (contains(name, c_name) OR contains(c_name, name) OR (length(trim(regexp_replace(name, '[（(].*$', ''))) >= 3 AND trim(regexp_replace(name, '[（(].*$', '')) = trim(regexp_replace(c_name, '[（(].*$', '')))) WHERE name NOT IN (SELECT c_name FROM c)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, (contains(teacher, c_teacher) OR contains(c_teacher, teacher)) DESC, c_name, c_teacher, credits, type) AS n FROM x)"""


@query(f"WITH {_ENRICH} SELECT r.id, r.name, r.teacher, tier, c_name, CASE WHEN credits > 0 THEN credits END AS credits, nullif(type, '') AS type FROM r LEFT JOIN (SELECT * EXCLUDE (name, teacher) FROM b WHERE n = 1) b ON b.id = r.id")
def fuzzy_enrich_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" II"))).otherwise(F.col("p_name"))
    records = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("teacher"))
    catalogue = p.where("p_size <= 10").select(F.col("p_name").alias("name"), F.col("p_brand").alias("teacher"), (F.col("p_size") % 4).alias("credits"), F.when(F.col("p_partkey") % 2 == 0, "選修").otherwise("").alias("type"))
    return R.enrich(records, catalogue)


@query("""WITH o AS (SELECT doc_id AS path, sha256(text) AS d FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'es' THEN text || '!' ELSE text END) AS d FROM documents WHERE lang <> 'de')
SELECT path, CASE WHEN o.d IS NULL THEN 'new' WHEN n.d IS NULL THEN 'deleted' WHEN o.d <> n.d THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL OUTER JOIN n USING (path)""")
def manifest_diff(spark, sf_dir):
    """Two snapshots: each lacks one language, and a third has changed."""
    d = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    old = d.where(lang != "fr").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    new = d.where(lang != "de").select(F.col("doc_id").alias("path"), F.sha2(F.when(lang == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return R.manifest_diff(old, new)


@query("WITH t AS (SELECT doc_id, lang, sha256('RETRIEVAL:64:' || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM t WHERE lang = 'en') SELECT doc_id, t.key IN (SELECT key FROM c) AS hit FROM t")
def embed_cache_split(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", R.cache_key("RETRIEVAL", 64, F.col("text")).alias("key"))
    return R.cache_split(t, t.where("lang = 'en'")).select("doc_id", "hit")


@query("SELECT doc_id, sha256(text) AS digest, sha256('QUERY:3072:' || text) AS key FROM documents")
def sha_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), R.cache_key("QUERY", 3072, F.col("text")).alias("key"))


_USERS = "u AS (SELECT c_custkey AS user_id, n_name AS dept, c_mktsegment AS grade, list_filter(['g' || (c_custkey % 3), CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE '' END], lambda x: x <> '') AS groups, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _users(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    groups = F.filter(F.array(F.concat(F.lit("g"), (F.col("c_custkey") % 3).cast("string")), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("")), lambda x: x != "")
    return c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("dept"), F.col("c_mktsegment").alias("grade"), groups.alias("groups"), "c_acctbal")


@query(f"WITH {_USERS} SELECT user_id FROM u WHERE contains(dept, 'A') AND grade = 'BUILDING' AND list_contains(groups, 'even')")
def audience_segment(spark, sf_dir):
    u = _users(spark, sf_dir)
    return u.where(F.col("dept").contains("A") & (F.col("grade") == "BUILDING") & F.array_contains("groups", "even")).select("user_id")


@query(f"WITH {_USERS}, m AS (SELECT unnest(groups) AS name, user_id FROM u) SELECT name, user_id, count(*) OVER (PARTITION BY name) AS n_members, min(user_id) OVER (PARTITION BY name) AS first_member FROM m")
def group_members(spark, sf_dir):
    """A row per member: a group may hold any share of the users, so its members are not gathered into one value."""
    m = _users(spark, sf_dir).select(F.explode("groups").alias("name"), "user_id")
    sizes = m.groupBy("name").agg(F.count("*").alias("n_members"), F.min("user_id").alias("first_member"))
    return m.join(sizes, "name").select("name", "user_id", "n_members", "first_member")


@query(f"WITH {_USERS} SELECT user_id, array_to_string(list_sort(list_distinct(list_append(groups, 'new'))), ',') AS joined, array_to_string(list_sort(list_filter(groups, lambda x: x <> 'even')), ',') AS left_, greatest(0, len(groups) - 2) AS clamped, upper(substr(sha256(groups[1]), 1, 6)) AS code FROM u")
def membership_ops(spark, sf_dir):
    u = _users(spark, sf_dir)
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return u.select("user_id", text(R.join_group(F.col("groups"), "new")).alias("joined"), text(R.leave_group(F.col("groups"), "even")).alias("left_"), F.greatest(F.lit(0), F.size("groups") - 2).alias("clamped"), R.invite_code(F.get("groups", F.lit(0))).alias("code"))


@query("""SELECT coalesce(o.k, n.k) AS user_id, CASE WHEN n.k IS NOT NULL THEN n.s ELSE o.s END AS segment, coalesce(o.b, n.b) AS balance
FROM (SELECT c_custkey AS k, c_mktsegment AS s, c_acctbal AS b FROM customer WHERE c_acctbal >= 0) o FULL OUTER JOIN (SELECT c_custkey AS k, lower(c_mktsegment) AS s, 0.0::DOUBLE AS b FROM customer WHERE c_mktsegment <> 'BUILDING') n ON o.k = n.k""")
def profile_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.lower("c_mktsegment").alias("segment"), F.lit(0.0).alias("balance"))
    return R.merge_profiles(old, new, "user_id", ["segment"], ["balance"])


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'tg' ELSE 'dc' END AS platform, count(o_orderkey) AS n_orders, count(o_orderkey) > 0 AS has_transcript, c_acctbal > 0 AS has_balance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def profile_completeness(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    orders = F.coalesce("n", F.lit(0)).cast("long")
    return c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, "tg").otherwise("dc").alias("platform"), orders.alias("n_orders"), (orders > 0).alias("has_transcript"), (F.col("c_acctbal") > 0).alias("has_balance"))


@query("SELECT n_nationkey, concat('user', n_nationkey) AS user_id, n_name FROM nation WHERE contains(n_name, 'A')")
def user_scan(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.where(F.col("n_name").contains("A")).select("n_nationkey", F.concat(F.lit("user"), F.col("n_nationkey").cast("string")).alias("user_id"), "n_name")


@query("SELECT p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name LIMIT 25")
def autocomplete(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("a")).select("p_name").orderBy("p_name").limit(25)


@query("SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'forbidden' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def send_outcomes(spark, sf_dir):
    outcome = F.when(F.col("event_id") % 10 == 0, "error").when(F.col("event_id") % 7 == 0, "forbidden").otherwise("success")
    return table(spark, sf_dir, "events").groupBy("event_type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT dept_short, count(DISTINCT course_name) AS n_courses, count(DISTINCT teacher) AS n_teachers FROM c GROUP BY dept_short ORDER BY n_courses DESC, dept_short")
def distinct_courses(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("dept_short").agg(F.count_distinct("course_name").alias("n_courses"), F.count_distinct("teacher").alias("n_teachers")).orderBy(F.desc("n_courses"), "dept_short")


@query(f"WITH c AS ({CHUNKS_SQL}), d AS (SELECT DISTINCT course_name, teacher FROM c WHERE academic_year = '114' AND semester = '1' AND ge_domain <> '') SELECT row_number() OVER (ORDER BY course_name, teacher) AS n, course_name, teacher FROM d")
def ge_roster(spark, sf_dir):
    c = chunks(spark, sf_dir).where("academic_year = '114' AND semester = '1' AND ge_domain <> ''").select("course_name", "teacher").distinct()
    return numbered(c, "course_name", "teacher").select("n", "course_name", "teacher")


@query(f"WITH c AS ({CHUNKS_SQL}), f AS (SELECT dept_short, course_name, min(node_id) AS first FROM c WHERE required_or_elective = '必修' AND dept_short <> 'es' GROUP BY ALL) SELECT dept_short, string_agg(course_name, '、' ORDER BY first) AS courses FROM f GROUP BY dept_short")
def required_roster(spark, sf_dir):
    c = chunks(spark, sf_dir).where("required_or_elective = '必修' AND dept_short <> 'es'")
    first = c.groupBy("dept_short", "course_name").agg(F.min("node_id").alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "course_name"))), lambda x: x["course_name"])
    return first.groupBy("dept_short").agg(F.array_join(names, "、").alias("courses"))


_GE = " ".join(f"WHEN regexp_matches(said || ' ' || n, '{'|'.join(words)}') THEN '{domain}'" for domain, words in R.GE_WORDS.items())


@query(f"""WITH d AS (SELECT replace(p_name, ' ', '') AS name, max(CASE p_size % 3 WHEN 0 THEN '人文' WHEN 1 THEN '社會' ELSE '自然' END) AS domain FROM part WHERE p_size <= 12 AND p_partkey % 4 <> 0 GROUP BY 1),
r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '（甲）' WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name ELSE p_brand END AS n, CASE p_size % 5 WHEN 0 THEN '數學' WHEN 1 THEN '經濟' ELSE '' END AS said FROM part),
x AS (SELECT *, replace(n, ' ', '') AS whole, regexp_replace(replace(n, ' ', ''), '[（(].*$', '') AS bare FROM r),
f AS (SELECT whole, min(name) AS near FROM (SELECT DISTINCT whole FROM x) JOIN d ON contains(whole, name) OR contains(name, whole) GROUP BY whole)
SELECT p_partkey, coalesce(a.domain, b.domain, c.domain, CASE {_GE} END, '{R.GE_DEFAULT}') AS domain
FROM x LEFT JOIN d a ON a.name = whole LEFT JOIN d b ON b.name = bare LEFT JOIN f USING (whole) LEFT JOIN d c ON c.name = near""")
def ge_domain_chain(spark, sf_dir):
    """Exact name, then the name without brackets, then one that holds the other, then words, then a default."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    domain = F.when(F.col("p_size") % 3 == 0, "人文").when(F.col("p_size") % 3 == 1, "社會").otherwise("自然")
    known = p.where("p_size <= 12 AND p_partkey % 4 <> 0").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name"), domain.alias("domain"))
    name = F.when(key % 4 == 0, F.concat("p_name", F.lit("（甲）"))).when(key % 4 == 1, F.concat_ws(" ", "p_name", "p_type")).when(key % 4 == 2, F.col("p_name")).otherwise(F.col("p_brand"))
    said = F.when(F.col("p_size") % 5 == 0, "數學").when(F.col("p_size") % 5 == 1, "經濟").otherwise("")
    return R.ge_domain(p.select(key.alias("id"), name.alias("name"), said.alias("domain")), known).select(F.col("id").alias("p_partkey"), F.col("resolved").alias("domain"))


@query("""WITH cand AS (SELECT s_suppkey AS student, l_partkey AS course, l_linenumber % 7 + 1 AS day, l_partkey % 13 + 1 AS period, l_quantity AS score FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
busy AS (SELECT DISTINCT l_suppkey AS student, l_linenumber % 7 + 1 AS day, l_partkey % 13 + 1 AS period, 1 AS busy FROM lineitem WHERE l_returnflag = 'N'),
passed AS (SELECT l_suppkey AS student, l_partkey AS course FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT student, course, max(coalesce(busy, 0)) AS clash, max(score) AS score FROM cand LEFT JOIN busy USING (student, day, period) WHERE NOT EXISTS (SELECT 1 FROM passed p WHERE p.student = cand.student AND p.course = cand.course) GROUP BY student, course)
SELECT student, course, clash, score, row_number() OVER (PARTITION BY student ORDER BY clash, score DESC, course) AS rank FROM r""")
def clash_aware_recommend(spark, sf_dir):
    s, l = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")  # noqa: E741
    day, period = (F.col("l_linenumber") % 7 + 1).alias("day"), (F.col("l_partkey") % 13 + 1).alias("period")
    candidates = s.join(l.where("l_returnflag = 'R'"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("student"), F.col("l_partkey").alias("course"), day, period, F.col("l_quantity").alias("score"))
    busy = l.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("student"), day, period)
    passed = l.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("student"), F.col("l_partkey").alias("course"))
    return R.recommend(candidates, busy, passed)


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT node_id, coalesce(CAST(try_cast(credits AS DOUBLE) AS INT), -1) AS credits, CASE WHEN grade = '一' THEN 1 WHEN grade = '二' THEN 2 ELSE 3 END AS year, class_group, CASE WHEN contains(dept_short, 'e') THEN '人文' WHEN contains(dept_short, 'f') THEN '社會' ELSE '自然' END AS domain FROM c")
def grade_infer(spark, sf_dir):
    c = chunks(spark, sf_dir)
    year = F.when(M.grade(["大一"]), 1).when(M.grade(["2"]), 2).otherwise(3)
    domain = F.when(F.col("dept_short").contains("e"), "人文").when(F.col("dept_short").contains("f"), "社會").otherwise("自然")
    return c.select("node_id", F.coalesce(R.whole_number(F.col("credits")), F.lit(-1)).alias("credits"), year.alias("year"), "class_group", domain.alias("domain"))
