"""Queries of text functions, record parsing, conversations and question routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import dates as D
from ..functions import dictionary, lexicon
from ..functions import text as T
from ..operators import events as E
from ..operators.records import accepted_upload
from ..sources import readers as S
from ..sources import sinks
from . import route as R
from .mapping import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CLIP = "CASE WHEN role = 'user' AND length(text) > 1000 THEN left(text, 1000) WHEN role = 'assistant' AND length(text) > 1200 THEN left(text, 800) || '…' || right(text, 300) ELSE text END"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, md5({_CLIP}) AS kept FROM r WHERE n <= 4")
def memory_window(spark, sf_dir):
    """The last two rounds of each conversation, long messages clipped."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = table(spark, sf_dir, "conversations").withColumn("n", n).where("n <= 4")
    return c.select("conv_id", "turn", "role", F.md5(T.clip_message(F.col("role"), F.col("text"))).alias("kept"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context FROM r WHERE n <= 4 GROUP BY conv_id")
def coref_context(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, sf_dir, "conversations").withColumn("n", n).where("n <= 4")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.concat(r["role"], F.lit(": "), r["text"]))
    return last.groupBy("conv_id").agg(F.md5(F.array_join(rows, "\n")).alias("context"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN left(c_name, (c_custkey % 6)::INT) WHEN 1 THEN upper(CASE c_custkey % 2 WHEN 0 THEN 'thanks' ELSE c_mktsegment END) ELSE left('你好嗎', (c_custkey % 4)::INT) END AS said FROM customer)
SELECT c_custkey, length(trim(said)) <= 2 OR lower(trim(said)) IN ('hello', 'hi there', 'thanks', 'good morning', '你好', '哈囉') AS trivial FROM s""")
def trivial_gate(spark, sf_dir):
    """Parts of names, greetings and other words, all between emoji."""
    key = F.col("c_custkey")
    said = F.when(key % 3 == 0, F.left("c_name", (key % 6).cast("int"))).when(key % 3 == 1, F.upper(F.when(key % 2 == 0, "thanks").otherwise(F.col("c_mktsegment")))).otherwise(F.left(F.lit("你好嗎"), (key % 4).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_trivial(F.concat(F.lit("😀"), said, F.lit(" 👍"))).alias("trivial"))


@query("SELECT event_id, event_type IN ('click', 'view') AND value * 1000000 <= 10485760 AS accepted FROM events")
def upload_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", accepted_upload(F.col("event_type"), F.col("value") * 1000000, ("click", "view")).alias("accepted"))


_MD = "'**' || p_name || '** & *' || p_brand || '* `' || p_type || '` [' || p_brand || '](https://x.test/' || p_partkey || ') < 5'"


@query(f"SELECT p_partkey, '<b>' || p_name || '</b> &amp; <i>' || p_brand || '</i> <code>' || p_type || '</code> <a href=\"https://x.test/' || p_partkey || '\">' || p_brand || '</a> &lt; 5' AS html FROM part")
def md_to_html(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("**"), "p_name", F.lit("** & *"), "p_brand", F.lit("* `"), "p_type", F.lit("` ["), "p_brand", F.lit("](https://x.test/"), F.col("p_partkey").cast("string"), F.lit(") < 5"))
    return p.select("p_partkey", T.markdown_to_html(text).alias("html"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '看 ' ELSE '[' || p_brand || '](<https://x.test/' || p_size || '>) 與 ' END || CASE p_partkey % 2 WHEN 0 THEN '<https://y.test/' || p_partkey || '?a=' || p_size || '>' ELSE '<https://z.test/' || p_size || '>' END || CASE p_partkey % 5 WHEN 0 THEN '' ELSE ' <http://w.test> ' || p_type END AS wrapped FROM part""")
def link_wrapping(spark, sf_dir):
    """Texts with and without named links, bare ones and ones that are wrapped already."""
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    named = F.when(key % 3 == 0, "看 ").otherwise(F.concat(F.lit("["), "p_brand", F.lit("](https://x.test/"), size, F.lit(") 與 ")))
    bare = F.when(key % 2 == 0, F.concat(F.lit("https://y.test/"), key.cast("string"), F.lit("?a="), size)).otherwise(F.concat(F.lit("<https://z.test/"), size, F.lit(">")))
    more = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" http://w.test "), "p_type"))
    return p.select("p_partkey", T.bare_links(F.concat(named, bare, more)).alias("wrapped"))


@query("""WITH s AS (SELECT p_partkey, p_name, p_type, repeat('<', (p_size % 4)::INT) AS lt, CASE p_partkey % 3 WHEN 0 THEN '（' || p_brand || '）' WHEN 1 THEN '(' || p_size || ')（' || p_brand || '）' ELSE '' END AS aside FROM part)
SELECT p_partkey, p_name || translate(lt, '<', '＜') || 'b>' || translate(lt, '<', '＜') AS escaped, trim(p_name || ' ' || p_type) AS bare FROM s""")
def escape_and_strip(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    less = F.repeat(F.lit("<"), (F.col("p_size") % 4).cast("int"))
    aside = F.when(key % 3 == 0, F.concat(F.lit("（"), "p_brand", F.lit("）"))).when(key % 3 == 1, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")（"), "p_brand", F.lit("）"))).otherwise("")
    return p.select("p_partkey", T.escape_markup(F.concat("p_name", less, F.lit("b>"), less)).alias("escaped"), T.strip_parens(F.concat("p_name", aside, F.lit(" "), "p_type", aside)).alias("bare"))


_NAMES = [(key, aliases[0]) for key, _, aliases, _ in lexicon.DEPARTMENTS if key.endswith("系") and len(aliases[0]) == 2]
_GRADES, _GROUPS = "一二三四", "甲乙丙丁"
_NUMBERS = "一二三四五六七八九"


def _at(letters, n):
    """One of some letters or words, by a number."""
    return F.get(F.array(*[F.lit(x) for x in letters]), n.cast("int"))


@query(f"""WITH k AS (SELECT c_custkey, c_custkey % 2 AS a, c_custkey % 3 AS b, c_custkey % 4 AS c, c_custkey % 5 AS d, c_custkey % 6 AS e, c_custkey % 7 AS f FROM customer)
SELECT c_custkey, CASE d WHEN 0 THEN NULL ELSE CAST(110 + d AS VARCHAR) END AS academic_year, CASE WHEN d = 0 THEN NULL ELSE CAST(a + 1 AS VARCHAR) END AS semester, '星期' || substr('{lexicon.WEEKDAYS}', f::INT + 1, 1) AS day_of_week,
CASE c WHEN 0 THEN NULL ELSE substr('{_GRADES}', c::INT, 1) END AS grade, (e + 1) || '-' || (e + 4) AS time_period, CASE b WHEN 1 THEN '必修' WHEN 2 THEN '選修' END AS required_or_elective,
CASE WHEN a = 1 AND b > 0 THEN 'personal_transcript' WHEN a = 1 THEN 'personal_schedule' WHEN b > 0 THEN 'course_info' ELSE 'general' END AS query_type FROM k""")
def route_rules(spark, sf_dir):
    """Questions put together from parts that customers' keys pick; who says 我 asks about their own timetable or, of required or elective courses, transcript."""
    key = F.col("c_custkey")
    term = F.when(key % 5 == 0, "").otherwise(F.concat((110 + key % 5).cast("string"), F.lit("學年度第"), _at("一二", key % 2), F.lit("學期")))
    year = F.when(key % 4 == 0, "").otherwise(F.concat(F.when(key % 8 < 4, F.concat(F.lit("大"), _at(_GRADES, key % 4 - 1))).otherwise(F.concat(_at(_GRADES, key % 4 - 1), F.lit("年級")))))
    day = F.concat(_at(["星期", "禮拜", "週"], key % 3), _at(lexicon.WEEKDAYS, key % 7))
    periods = F.concat(F.lit("第"), _at(_NUMBERS, key % 6), F.lit("到"), _at(_NUMBERS, key % 6 + 3), F.lit("節"))
    q = F.concat(F.when(key % 2 == 1, "我").otherwise(""), term, _at([n for _, n in _NAMES], key % len(_NAMES)), F.lit("系"), year, day, periods, F.when(key % 3 == 1, "的必修").when(key % 3 == 2, "的選修").otherwise("有課"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", R.academic_year(q).alias("academic_year"), R.semester(q).alias("semester"), R.weekday(q).alias("day_of_week"), R.grade(q).alias("grade"),
        R.period_range(q).alias("time_period"), R.required_or_elective(q).alias("required_or_elective"), R.question_type(q).alias("query_type"),
    )


_D = "(VALUES " + ", ".join(f"({i}, '{key}')" for i, (key, _) in enumerate(_NAMES)) + ") v(i, d)"


@query(f"""WITH k AS (SELECT c_custkey, c_custkey % {len(_NAMES)} AS a, c_custkey // 3 % {len(_NAMES)} AS b, c_custkey % 2 AS m FROM customer), n AS (SELECT * FROM {_D}),
p AS (SELECT c_custkey, m, a AS i FROM k UNION SELECT c_custkey, m, b FROM k)
SELECT c_custkey, string_agg(CASE m WHEN 1 THEN replace(d, '系', '碩') ELSE d END, ',' ORDER BY i) AS departments, substr('{_GRADES}', (c_custkey % 4)::INT + 1, 1) AS grade, substr('{_GROUPS}', (c_custkey // 4 % 4)::INT + 1, 1) AS class_group,
       chr((65 + c_custkey % 26)::INT) || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS classroom, CASE c_custkey % 4 WHEN 0 THEN '人文' WHEN 1 THEN '社會' WHEN 2 THEN '自然' END AS ge_domain FROM p JOIN n USING (i) GROUP BY c_custkey""")
def route_entities(spark, sf_dir):
    """Two departments (or twice the same one), of their master's programmes if the question says so, with a year behind the short name, a class and a room."""
    key, names = F.col("c_custkey"), [n for _, n in _NAMES]
    room = F.concat(F.chr((65 + key % 26).cast("int")), F.lpad((key % 1000).cast("string"), 3, "0"))
    q = F.concat(_at(names, key % len(names)), _at(_GRADES, key % 4), F.lit("跟"), _at(names, F.floor(key / 3) % len(names)), _at(_GRADES, key % 4), _at(_GROUPS, F.floor(key / 4) % 4), F.lit("在"), room, F.when(key % 2 == 1, "的研究所").otherwise("的課"))
    domain = F.concat(F.lit("通識的"), _at(["人文", "社會", "自然", "語言"], key % 4))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(R.departments(q), ",").alias("departments"), R.grade(q).alias("grade"), R.class_group(q).alias("class_group"), R.classroom(q).alias("classroom"), R.ge_domain(domain).alias("ge_domain"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '|' || c_mktsegment ELSE c_name || '|' || c_mktsegment || '|' || c_nationkey END AS queries, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS existing,
       c_custkey % 3 > 0 AND c_custkey % 2 = 1 AS needs_history FROM customer""")
def route_validate(spark, sf_dir):
    """Rewritten queries each once behind the question; entities that are in the question and hold no digit; pronouns without a department."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rewritten = F.when(key % 3 == 0, F.array("c_mktsegment", "c_name", "c_mktsegment")).otherwise(F.array(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_name")))
    said = F.concat("c_name", F.when(key % 2 == 0, F.concat(F.col("c_mktsegment"), F.lit("資工系"))).otherwise(""), _at(["", "這門課", "他"], key % 3))
    kept = R.existing(said, F.array("c_mktsegment", "c_name", F.lit("other")))
    return c.select("c_custkey", F.array_join(R.search_queries(F.col("c_name"), rewritten), "|").alias("queries"), F.array_join(kept, "|").alias("existing"), R.needs_history(said).alias("needs_history"))


_SPOKEN = list(lexicon.SYNONYMS)


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(lexicon.SYNONYMS.items())) + f""") v(i, spoken, official)),
w AS (SELECT c_custkey, spoken AS a FROM customer JOIN s ON i = c_custkey % {len(_SPOKEN)} UNION ALL SELECT c_custkey, c_mktsegment || spoken FROM customer JOIN s ON i = c_custkey * 7 % {len(_SPOKEN)}),
x AS (SELECT c_custkey, a AS word FROM w UNION SELECT c_custkey, unnest(string_split(official, ' ')) FROM w JOIN s ON contains(a, spoken))
SELECT c_custkey, string_agg(word, '|' ORDER BY encode(word)) AS words FROM x GROUP BY c_custkey""")
def query_expand(spark, sf_dir):
    """Two spoken words of each customer with the calendar's words for them."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    words = F.array(_at(_SPOKEN, key % len(_SPOKEN)), F.concat("c_mktsegment", _at(_SPOKEN, key * 7 % len(_SPOKEN))))
    return c.select("c_custkey", F.array_join(F.array_sort(E.expanded(words)), "|").alias("words"))


@query("""WITH s AS (SELECT * FROM (VALUES (0, '英文', '應英系 英文老師 大一英文 英文課 應用英語學系'), (1, '運動', '體育課 體育老師 體育室 推薦'), (2, 'ba', '企管系 企管老師 企業管理學系 企管')) v(i, name, words)),
k AS (SELECT c_custkey, c_custkey % 5 AS i, left(c_mktsegment, 3 + (c_custkey % 4)::INT) AS other FROM customer)
SELECT c_custkey, CASE i WHEN 3 THEN other || '系 ' || other || '機械老師 ' || other || '課' WHEN 4 THEN CASE WHEN length(other) <= 4 THEN other || ' 老師 評價 ' || other || ' 教授' ELSE other || ' 老師 ' || other || ' 課' END ELSE words END AS words FROM k LEFT JOIN s USING (i)""".replace("other || '系 ' || other || '機械老師 ' || other || '課'", "other || '機械系 ' || other || '機械老師 ' || other || '機械課'"))
def opinion_queries(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    other = F.left("c_mktsegment", (3 + key % 4).cast("int"))
    subject = F.when(key % 5 < 3, _at(["英文", "運動", "ba"], key % 5)).when(key % 5 == 3, F.concat(other, F.lit("機械系"))).otherwise(other)
    return c.select("c_custkey", R.opinion_query(F.concat(subject, _at(["教授", "老師", "課"], key % 3))).alias("words"))


_RECORD = "concat('課程名稱：', p_name, chr(10), '開課班級：資工', case when p_partkey % 2 = 0 then '二甲' else '三乙' end, chr(10), '授課教師：', p_brand, chr(10), '學分數：', cast(p_size % 4 as string), chr(10), '課程教學目標：認識 ', p_type, chr(10), '課程教學綱要：', p_name, chr(10), '教科書資料：無', chr(10))"


def _records(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("114-1/"), F.col("p_partkey").cast("string")).alias("path"), F.expr(_RECORD).alias("text"))


@query("SELECT '114-1/' || p_partkey AS path, p_name AS course_name, p_brand AS teacher, cast(p_size % 4 AS VARCHAR) AS credits, '未知' AS hours, CASE WHEN p_partkey % 2 = 0 THEN '二' ELSE '三' END AS grade, CASE WHEN p_partkey % 2 = 0 THEN '甲' ELSE '乙' END AS class_group, '0' AS semester FROM part")
def header_parse(spark, sf_dir):
    return S.course_records(_records(spark, sf_dir)).select("path", "course_name", "teacher", "credits", "hours", "grade", "class_group", "semester")


@query("SELECT '114-1/' || p_partkey AS path, '認識 ' || p_type AS objectives, p_name AS syllabus, '無' AS textbooks, '' AS grading FROM part")
def section_slice(spark, sf_dir):
    s = S.course_records(_records(spark, sf_dir)).select("path", "sections")
    return s.select("path", *[F.element_at("sections", k).alias(k) for k in ("objectives", "syllabus", "textbooks", "grading")])


@query("SELECT s_suppkey, unnest([0, 1]) AS n, unnest([s_name, '未提供']) AS name, unnest(['s' || s_suppkey || '@x.test', '未提供']) AS email, unnest(['未提供', '082-31' || s_suppkey]) AS phone FROM supplier")
def record_split(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("【甲】 姓名："), "s_name", F.lit("\n電子郵件：s"), key, F.lit("@x.test\n---\n短\n---\n【乙】 這是另一位教授的紀錄，沒有名字。\n聯絡電話：082-31"), key)
    pieces = S.record_pieces(s.select(F.col("s_suppkey").alias("path"), text.alias("text")))
    order = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    return pieces.select(F.col("path").alias("s_suppkey"), order.alias("n"), *S.contact(F.col("piece")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'skip' WHEN p_partkey % 5 = 0 THEN 'professor' WHEN p_partkey % 11 = 0 THEN 'dept_info' WHEN p_partkey % 3 > 0 OR p_partkey % 4 = 0 THEN 'course' ELSE 'unknown' END AS kind FROM part""")
def dir_classifier(spark, sf_dir):
    """Folder names of a number, a separator, a term and the words that keys pick."""
    key = F.col("p_partkey")
    term = F.concat((100 + key % 20).cast("string"), _at(["-", "_", ""], F.floor(key / 3) % 3), _at(["x", "1", "2"], key % 3))
    words = F.concat(F.when(key % 4 == 0, "_Course課程").otherwise(""), F.when(key % 11 == 0, "系所").otherwise(""), F.when(key % 5 == 0, "_professor").otherwise(""), F.when(key % 7 == 0, "_BackUp").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", S.folder_kind(F.concat(term, words)).alias("kind"))


@query("""SELECT year, max(semester) AS semester FROM (SELECT CAST(year(o_orderdate) - 1811 AS VARCHAR) AS year, CAST(1 + o_custkey % 2 AS VARCHAR) AS semester FROM orders WHERE o_orderkey % 3 > 0 AND year(o_orderdate) % 4 > 0)
WHERE year = (SELECT max(CAST(year(o_orderdate) - 1811 AS VARCHAR)) FROM orders WHERE o_orderkey % 3 > 0 AND year(o_orderdate) % 4 > 0) GROUP BY year""")
def current_term(spark, sf_dir):
    """Backups and folders without a term do not count; the latest term of three digits wins."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    name = F.concat((year - 1811).cast("string"), F.when(key % 2 == 0, "-").otherwise("_"), (1 + F.col("o_custkey") % 2).cast("string"), F.when(key % 3 == 0, "_backup").otherwise(""))
    return S.latest_term(table(spark, sf_dir, "orders").select(F.when(year % 4 == 0, "notes").otherwise(name).alias("path")))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g') AS body FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(body, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM l) SELECT page_id, count(*) AS n_links, md5(string_agg(url || ' ' || title, ',' ORDER BY url, title)) AS links FROM t WHERE length(title) >= 1 GROUP BY page_id""")
def page_links(spark, sf_dir):
    rows = S.page_links(table(spark, sf_dir, "pages"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("url", "title"))), lambda x: F.concat(x["url"], F.lit(" "), x["title"]))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.md5(F.array_join(each, ",")).alias("links"))


@query("WITH t AS (SELECT page_id AS n, url AS title FROM pages), h AS (SELECT * FROM t WHERE contains(lower(title), '7') OR contains(lower(title), 'xyz') ORDER BY n LIMIT 15) SELECT n, title FROM h")
def news_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.col("url").alias("title"))
    return S.matching_news(rows, ["7", "XYZ"], ["n"])


_NUMERALS = "一 二 三 四 五 六 七 八 九 十 十一 十二 十三 十四 十五 十六 十七 十八 十九 二十 二十一 二十二 二十三 二十四 二十五 二十六 二十七 二十八 二十九 三十 三十一".split()
_DAYS = ["今天", "明天", "後天", "大後天"]


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, 1 + o_orderkey % 12 AS h, 1 + o_orderkey % 31 AS m, 1 + o_orderkey % 9 AS k, o_orderkey % 4 AS r, o_orderkey % 7 AS w FROM orders)
SELECT o_orderkey, strftime(DATE '2024-01-01' + r::INT, '%Y-%m-%d') || '，' || month(d) || '月' || day(d) || '號，' || month(d) || '/' || day(d) || '，' ||
       CASE WHEN r < 2 THEN CASE h WHEN 12 THEN 0 ELSE h END ELSE CASE h WHEN 12 THEN 12 ELSE h + 12 END END || '點' || m || '分，第' || k || '節到第' || (k + 4) || '節，' ||
       strftime(DATE '2024-01-01' + (7 + w)::INT, '%Y-%m-%d') || '，' || strftime(DATE '2024-01-01' + m::INT, '%Y-%m-%d') || '，星期' || substr('{lexicon.WEEKDAYS}', (w + 1)::INT, 1) AS said FROM o""")
def normalise_dates(spark, sf_dir):
    """What orders' dates and keys say in Han numerals, in digits; the reference day is 2024-01-01, a Monday."""
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    number = lambda n: pick(_NUMERALS, n - 1)
    weekday = F.get(F.split(F.lit(",".join(lexicon.WEEKDAYS)), ","), (key % 7).cast("int"))
    said = F.concat(
        pick(_DAYS, key % 4), F.lit("，"), number(F.month(day)), F.lit("月"), number(F.day(day)), F.lit("號，"), number(F.month(day)), F.lit("/"), F.day(day).cast("string"), F.lit("，"),
        F.when(key % 4 < 2, "早上").otherwise("晚上"), number(1 + key % 12), F.lit("點"), number(1 + key % 31), F.lit("分，第"), number(1 + key % 9), F.lit("節到第"), (5 + key % 9).cast("string"), F.lit("節，下週"), weekday,
        F.lit("，"), number(1 + key % 31), F.lit("天後，禮拜"), weekday,
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", D.normalised(said, dt.date(2024, 1, 1)).alias("said"))


@query(r"""WITH t AS (SELECT p_partkey, '用' || p_brand || '學' || p_size || '次' || p_type || '（' || p_name || '）很好' || p_size || '%的' AS x FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(x, '(\p{Han})([A-Za-z0-9])', '\1 \2', 'g'), '([A-Za-z0-9%])(\p{Han})', '\1 \2', 'g') || ' `a中b' || p_size || '` https://x.test/中' || p_partkey AS spaced FROM t JOIN part USING (p_partkey)""")
def spacing(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    text = F.concat(F.lit("用"), "p_brand", F.lit("學"), size, F.lit("次"), "p_type", F.lit("（"), "p_name", F.lit("）很好"), size, F.lit("%的 `a中b"), size, F.lit("` https://x.test/中"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", T.spaced(text).alias("spaced"))


#: Letters, and Han characters that stand for all of them or for the first half.
_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘"
_SPACE = r"[\x20\x09-\x0D]"
_SINGLE = C.SINGLE


@query(f"""WITH RECURSIVE x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN translate(text, '{_LETTERS}.', '{_HAN}。') WHEN 1 THEN translate(text, '{_LETTERS[:13]}', '{_HAN[:13]}') ELSE text END AS text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(text, '{_SPACE}*(?:[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]+)') AS toks FROM x),
t AS (SELECT doc_id, len(toks) AS most, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS n FROM l),
w AS (SELECT doc_id, n, most, regexp_replace(tok, '^{_SPACE}+', '') AS word, regexp_extract(coalesce(lead(tok) OVER (PARTITION BY doc_id ORDER BY n), ''), '^{_SPACE}*') AS gap FROM t),
c AS (SELECT *, right(coalesce(nullif(rtrim(word, '"''”’)]》」』）'), ''), word), 1) AS last FROM w),
e AS (SELECT doc_id, n, last IN ('。', '！', '？', '；') OR last IN ('.', '!', '?', ';') AND gap <> '' OR contains(gap, chr(10)) OR n = most AS ends FROM c),
g AS (SELECT doc_id, n, ends, coalesce(max(n) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM e),
s AS (SELECT doc_id, n AS b, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY n), 0) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM g WHERE ends OR (n - begin) % {C.SIZE} = 0),
stop AS (SELECT s.doc_id, s.k, max(o.k) AS stop FROM s JOIN s o ON s.doc_id = o.doc_id AND o.k >= s.k AND o.b - s.a <= {C.SIZE} GROUP BY ALL),
span AS (SELECT stop.doc_id, stop.k, stop, s.a, o.b, p.b AS after FROM stop JOIN s ON s.doc_id = stop.doc_id AND s.k = stop.k JOIN s o ON o.doc_id = stop.doc_id AND o.k = stop LEFT JOIN s p ON p.doc_id = stop.doc_id AND p.k = stop + 1),
nxt AS (SELECT span.*, coalesce((SELECT min(i.k) FROM s i WHERE i.doc_id = span.doc_id AND i.k > span.k AND i.k <= span.stop AND span.b - i.a <= {C.OVERLAP} AND span.after - i.a <= {C.SIZE}), stop + 1) AS go FROM span),
r AS (SELECT doc_id, 0 AS chunk, a, b, after, go FROM nxt WHERE k = 1 UNION ALL SELECT r.doc_id, r.chunk + 1, nxt.a, nxt.b, nxt.after, nxt.go FROM r JOIN nxt ON nxt.doc_id = r.doc_id AND nxt.k = r.go WHERE r.after IS NOT NULL)
SELECT doc_id, chunk, a AS first_token, b - a AS n_tokens, md5(regexp_replace(array_to_string(toks[a + 1 : b], ''), '^{_SPACE}+', '')) AS text FROM r JOIN l USING (doc_id)""")
def token_chunks(spark, sf_dir):
    """Chunks of whole sentences of texts in Han characters, in both scripts, and in Latin letters."""
    text, key = F.col("text"), F.col("doc_id") % 3
    mixed = F.when(key == 0, F.translate(text, f"{_LETTERS}.", f"{_HAN}。")).when(key == 1, F.translate(text, _LETTERS[:13], _HAN[:13])).otherwise(text)
    found = C.chunk_rows(table(spark, sf_dir, "documents").select("doc_id", mixed.alias("text")))
    return found.select("doc_id", "chunk", "first_token", "n_tokens", F.md5("text").alias("text"))


_DIGITS, _STEMS, _SKY = "0123456789", "甲乙丙丁戊己庚辛壬癸", "山水火木金土日月星辰"


@query(f"""WITH n AS (SELECT count(*) AS n FROM supplier),
t AS (SELECT p_partkey, translate(CAST(p_partkey % n AS VARCHAR), '{_DIGITS}', '{_STEMS}') || '概論' AS name, translate(CAST(p_partkey AS VARCHAR), '{_DIGITS}', '{_SKY}') AS tail, p_brand FROM part, n)
SELECT p_partkey, array_to_string(list_filter([name] || CASE WHEN length(tail) > 2 THEN list_transform(range(1, length(tail)), lambda i: substr(tail, i, 2)) ELSE [tail] END || regexp_extract_all(lower(p_brand), '[a-z0-9]+'), lambda x: length(x) > 1), ' ') AS terms FROM t""")
def dictionary_terms(spark, sf_dir):
    """Questions about courses of a registry as large as ``supplier``: names whole, stop words gone, the rest in pairs."""
    suppliers, key = table(spark, sf_dir, "supplier"), F.col("p_partkey")
    name = lambda k: F.concat(F.translate(k.cast("string"), _DIGITS, _STEMS), F.lit("概論"))
    n = suppliers.count()
    names = dictionary.names_of(spark.range(n).select(name(F.col("id")).alias("name")))
    said = F.concat(F.lit("請問一下"), name(key % n), F.lit("在哪裡 "), F.translate(key.cast("string"), _DIGITS, _SKY), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.query_tokens(said, T.tokenizer(names)), " ").alias("terms"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT p_partkey, p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS title, count(*) OVER () AS m FROM part),
q AS (SELECT c_custkey, '請問' || s_name || '老師的' || a.title || '跟' || b.title AS said, s_name FROM customer, n JOIN supplier ON s_suppkey = c_custkey % n JOIN p a ON a.p_partkey = c_custkey % a.m JOIN p b ON b.p_partkey = c_custkey * 7 % b.m)
SELECT c_custkey, s_name AS teachers, string_agg(title, ',' ORDER BY length(title) DESC, title) AS courses FROM q JOIN p ON contains(said, title) GROUP BY ALL""")
def route_names(spark, sf_dir):
    """Teachers and courses that questions name, out of all suppliers and parts."""
    s, key = table(spark, sf_dir, "supplier"), F.col("c_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("title"))
    n, m = s.count(), p.count()
    part = lambda side: p.select(F.col("p_partkey").alias(side), F.col("title").alias(f"{side}_title"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", (key % n).alias("s_suppkey"), (key % m).alias("a"), (key * 7 % m).alias("b"))
    named = asked.join(s.select("s_suppkey", "s_name"), "s_suppkey").join(part("a"), "a").join(part("b"), "b")
    said = F.concat(F.lit("請問"), "s_name", F.lit("老師的"), "a_title", F.lit("跟"), "b_title")
    asked = sinks.kept(named.select("c_custkey", said.alias("said")), "asked")
    found = R.with_courses(R.with_teachers(asked, F.col("said"), s.select(F.col("s_name").alias("name"))), F.col("said"), p.select(F.col("title").alias("name")))
    return found.select("c_custkey", F.array_join("teachers", ",").alias("teachers"), F.array_join("courses", ",").alias("courses"))


@query()
def message_split(spark, sf_dir):
    """Parts of at most 1900 characters; sequential within a text, so tested against the text itself."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.message_parts(F.col("text"), 1900)).alias("n", "part")).select("doc_id", "n", F.length("part").alias("size"))


@query()
def repeated_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(T.without_repeats(F.concat("text", F.lit("\n\n"), "text"))).alias("kept"), F.length("text").alias("size"))




@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 4 < 3")
def json_repair(spark, sf_dir):
    """Answers of a model: as they should be, of another language's quotes with talk around, bare and cut off, and without an object."""
    key, name, segment, nation = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = (
        F.when(key % 4 == 0, put('{"name": "', name, '", "segment": "', segment, '", "nation": ', nation, "}"))
        .when(key % 4 == 1, put("說明：{'name': '", name, "', 'segment': '", segment, "' 'nation': ", nation, ",} 如上"))
        .when(key % 4 == 2, put("```json\n{schedule: {name: ", name, ", segment: ", segment, " nation: ", nation))
        .otherwise(put("{", name))
    )
    good, _ = S.json_records(table(spark, sf_dir, "customer").select("c_custkey", said.alias("json")), "name string, segment string, nation int")
    return good.select("c_custkey", "record.name", "record.segment", "record.nation")


_NOTICE = "(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"


@query(f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g') AS body FROM pages WHERE page_id % 3 = 2),
l AS (SELECT page_id, unnest(range(len(regexp_extract_all(body, '{_NOTICE}')))) AS n, unnest(regexp_extract_all(body, '{_NOTICE}', 1)) AS url, trim(unnest(regexp_extract_all(body, '{_NOTICE}', 2))) AS title FROM b),
o AS (SELECT page_id, n, title, url FROM l WHERE length(title) >= 8 AND NOT starts_with(url, '#') AND NOT starts_with(url, 'javascript:') QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY n) = 1)
SELECT page_id, title, CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://site' || url END AS url, '' AS unit, '' AS date FROM o QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 15
UNION ALL SELECT page_id, 'Announcement ' || page_id, CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://site' || url END, '', '' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'Notice & ' || page_id, 'http://site/p/' || page_id, 'Unit ' || page_id % 7 || 'x', '2026-03-0' || (page_id % 9 + 1) FROM pages WHERE page_id % 3 = 1""")
def page_announcements(spark, sf_dir):
    """Whole pages as they are, behind a content area, and behind a table of announcements with a table in a cell and cells left open."""
    key, n = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    area = put("<a href='/menu'>an entry of the menu</a><div class='wide mpgdetail'><p><a href='", F.col("url"), "'>Announcement ", n, "</a></div>", F.col("html"))
    listed = put("<table class=\"table x\"><tr><td>2026-03-0", (key % 9 + 1).cast("string"), "<td><a href='/p/", n, "'>Notice &amp; <b>", n, "</b></a><td>Unit ", (key % 7).cast("string"), "<table><tr><td>x</table><tr><td>no</td><td>link</td></table>", F.col("html"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(key % 3 == 0, area).when(key % 3 == 1, listed).otherwise(F.col("html")))
    return S.announcements(pages, "http://site").drop("n")


_FOLDERS = [(key, full) for key, full, _, _ in lexicon.DEPARTMENTS if key.endswith("系")]


@query("WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{key}')" for i, (key, _) in enumerate(_FOLDERS)) + f""") v(i, d))
SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN CASE p_partkey % 3 WHEN 1 THEN '未知系' ELSE '未知碩' END WHEN p_partkey % 3 = 1 THEN d ELSE replace(d, '系', '碩') END AS department FROM part JOIN n ON i = p_partkey % {len(_FOLDERS)}""")
def path_departments(spark, sf_dir):
    """Folders named after departments, or after none, of two divisions."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("114-1/"), F.when(key % 7 == 6, F.lit("other")).otherwise(_at([full for _, full in _FOLDERS], key % len(_FOLDERS))), F.lit("/"), "p_name", F.lit(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", S.path_department(path, _at(["碩士班", "日間部", "進修研究所"], key % 3)).alias("department"))


@query("""WITH k AS (SELECT c_custkey, c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN '早上' WHEN 1 THEN '上午' WHEN 2 THEN '下午' WHEN 3 THEN '晚上' ELSE '中午' END || CASE c_custkey % 7 WHEN 0 THEN '有空嗎' WHEN 1 THEN '星期三' WHEN 2 THEN '的學分' ELSE '' END AS q FROM customer)
SELECT c_custkey, q || CASE c_custkey % 5 WHEN 0 THEN ' (第1節 第2節 第3節 第4節 上午)' WHEN 1 THEN ' (第1節 第2節 第3節 第4節)' WHEN 2 THEN ' (第5節 第6節 第7節 第8節 第9節)' WHEN 3 THEN ' (第10節 第11節 第12節 夜間)' ELSE '' END AS question,
CASE c_custkey % 7 WHEN 0 THEN 'free' WHEN 1 THEN 'day' WHEN 2 THEN 'credits' ELSE CASE c_custkey % 2 WHEN 0 THEN 'course' ELSE 'full' END END AS topic FROM k""")
def period_questions(spark, sf_dir):
    """Questions with times of day, and which part of a timetable they are about."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    q = F.concat("c_mktsegment", _at(["早上", "上午", "下午", "晚上", "中午"], key % 5), F.when(key % 7 == 0, "有空嗎").when(key % 7 == 1, "星期三").when(key % 7 == 2, "的學分").otherwise(""))
    courses = F.array(F.lit(""), F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("none"))
    return c.select("c_custkey", R.with_periods(q).alias("question"), R.schedule_topic(q, courses).alias("topic"))


@query("""WITH x AS (SELECT o_orderkey, o_orderdate - INTERVAL 1 DAY AS now, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS e,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate + to_days(CAST(o_orderkey % 4 - 2 AS INT)) END AS t FROM orders)
SELECT o_orderkey, epoch_us(coalesce(s, t, now)) AS low, epoch_us(CASE WHEN s IS NOT NULL THEN CASE WHEN e IS NOT NULL THEN e WHEN t + INTERVAL 1 DAY > s THEN t + INTERVAL 1 DAY ELSE s + INTERVAL 30 DAY END WHEN t IS NOT NULL THEN t + INTERVAL 1 DAY ELSE now + INTERVAL 7 DAY END) AS high FROM x""")
def list_windows(spark, sf_dir):
    """What a calendar listing searches, with and without a start, an end and a target."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    later = lambda n: day + F.make_interval(days=n if not isinstance(n, int) else F.lit(n))
    low, high = D.list_range(F.when(key % 2 == 0, day), F.when(key % 3 == 0, later(5)), F.when(key % 5 < 3, later((key % 4 - 2).cast("int"))), later(-1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(low).alias("low"), F.unix_micros(high).alias("high"))
