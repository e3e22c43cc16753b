"""Queries of calendar events, dates, sessions and rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import lexicon
from ..operators import events as E
from ..operators import match as M
from .mapping import events, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_E = "e AS (SELECT event_id, user_id, event_type AS title, ts AS start, value, props FROM events)"
#: Titles in the domain's language, by event id.
_TITLE = "CASE event_id % 9 WHEN 0 THEN '期中考週' WHEN 1 THEN '[課程] 資料結構' WHEN 2 THEN '國慶日放假' WHEN 3 THEN '第九週課程進度' WHEN 4 THEN '調整放假補假' WHEN 5 THEN '[期中考] 互動式網頁程式設計' WHEN 6 THEN '校慶 停課' WHEN 7 THEN '臺北參訪' ELSE event_type END"


def titled(spark, sf_dir):
    return events(spark, sf_dir).withColumn("title", F.expr(_TITLE.replace("event_type", "title")))


_T = f"e AS (SELECT event_id, user_id, {_TITLE} AS title, ts AS start, value FROM events)"


@query(f"WITH {_T} SELECT event_id, title, CASE WHEN contains(title, '國慶') THEN 3 ELSE 0 END + CASE WHEN contains(title, '國慶日') THEN 3 ELSE 0 END + CASE WHEN contains(title, '放假') THEN 1 ELSE 0 END AS score FROM e WHERE contains(title, '國慶') OR contains(title, '放假')")
def event_search(spark, sf_dir):
    score = E.keyword_score(F.col("title"), E.expand(["國慶"]), ["放假"])
    return titled(spark, sf_dir).select("event_id", "title", score.alias("score")).where("score > 0")


_TIERS = [("week", "第九周進度"), ("web", "互動式網頁期中考"), ("both", "資料結構與校慶"), ("taipei", "台北"), ("star", "*")]


def _tier_sql(word: str) -> str:
    w = word.lower().replace("週", "周").replace("台", "臺")
    import re

    if word == "*":
        return "1"
    bare = "title"
    for p in ("[自訂]", "[課程]", "[期中考]", "[期末考]"):
        bare = f"trim(replace({bare}, '{p}', ''))"
    bare, whole = f"translate(lower({bare}), '週台', '周臺')", "translate(lower(title), '週台', '周臺')"
    either = lambda p: f"(contains({bare}, '{p}') OR contains({whole}, '{p}'))"
    parts = [p for p in re.split(r"跟|與|和|及|、|,|\s+", w) if len(p) >= 2]
    out = f"CASE WHEN {either(w)} THEN 2 WHEN " + (" OR ".join(map(either, parts)) or "false") + " THEN 3"
    if len(w) >= 4:
        clean = f"translate({whole}, '[]', '')"
        out += " WHEN " + " AND ".join(f"contains({clean}, '{c}')" for c in sorted(set(w))) + " AND (" + " OR ".join(f"contains({clean}, '{w[i : i + 3]}')" for i in range(len(w) - 2)) + ") THEN 4"
        gaps = ".{0,3}".join(w)
        out += f" WHEN regexp_matches({bare}, '{gaps}') OR regexp_matches({whole}, '{gaps}') THEN 5"
    return out + " ELSE 0 END"


@query(f"WITH {_T} SELECT event_id, " + ", ".join(f"{_tier_sql(w)} AS {k}" for k, w in _TIERS) + " FROM e")
def title_match_tiers(spark, sf_dir):
    return titled(spark, sf_dir).select("event_id", *[M.title_matches(F.col("title"), w).alias(k) for k, w in _TIERS])


_DAYS = "d AS (SELECT event_id, title, unnest(generate_series(start::DATE::TIMESTAMP, (start + to_minutes(cast(value AS BIGINT) * 20))::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM e)"


def _spans(spark, sf_dir):
    """Holiday-like events that last ``value`` times twenty minutes."""
    e = titled(spark, sf_dir)
    return e.withColumn("end", F.timestamp_micros(F.unix_micros("start") + F.col("value").cast("long") * 20 * 60 * 1_000_000))


@query(f"WITH {_T}, {_DAYS.replace('cast(value AS BIGINT)', 'trunc(value)::BIGINT')} SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM d WHERE contains(title, '放假') OR contains(title, '補假')")
def holiday_expand(spark, sf_dir):
    e = _spans(spark, sf_dir).where(E.is_holiday(F.col("title")))
    return E.days_of(e).select(F.date_format("day", "yyyy-MM-dd").alias("day")).distinct()


@query(f"WITH {_T}, core AS (SELECT min(start::DATE) - 3 AS lo, max(start::DATE) + 3 AS hi FROM e WHERE contains(title, '校慶')) SELECT event_id FROM e, core WHERE contains(title, '放假') AND start::DATE BETWEEN lo AND hi")
def holiday_proximity(spark, sf_dir):
    e = titled(spark, sf_dir)
    return E.near_core(e.where(E.is_holiday(F.col("title"))), e.where(F.col("title").contains("校慶"))).select("event_id")


@query(f"WITH {_T} SELECT CAST(min(start::DATE) AS VARCHAR) AS low, CAST(max(start::DATE) AS VARCHAR) AS high, count(*) AS n FROM e WHERE contains(title, '期中考')")
def core_date_bounds(spark, sf_dir):
    day = lambda f: F.date_format(f(F.to_date("start")), "yyyy-MM-dd")
    return titled(spark, sf_dir).where(F.col("title").contains("期中考")).agg(day(F.min).alias("low"), day(F.max).alias("high"), F.count("*").alias("n"))


@query(f"""WITH {_T}, core AS (SELECT event_id, start FROM e WHERE contains(title, '國慶') ORDER BY start, event_id LIMIT 8), near AS (SELECT event_id, start FROM e WHERE contains(title, '補假') AND event_id NOT IN (SELECT event_id FROM core))
SELECT event_id FROM core UNION ALL SELECT event_id FROM near""")
def event_union(spark, sf_dir):
    e = titled(spark, sf_dir)
    core = e.where(F.col("title").contains("國慶")).orderBy("start", "event_id").limit(8).select("event_id")
    near = e.where(F.col("title").contains("補假")).join(core, "event_id", "left_anti").select("event_id")
    return core.unionByName(near)


@query(f"""WITH {_T}, h AS (SELECT DISTINCT user_id AS id, start::DATE AS day FROM e WHERE contains(title, '放假')), g AS (SELECT *, day - lag(day) OVER (PARTITION BY id ORDER BY day) AS gap FROM h),
r AS (SELECT id, min(day) AS first, max(day) AS last, coalesce(max(gap), 0) <= 2 AS consecutive FROM g GROUP BY id),
s AS (SELECT id, consecutive, CASE WHEN consecutive AND isodow(first) = 1 THEN first - 2 WHEN consecutive AND isodow(first) = 7 THEN first - 1 ELSE first END AS a, CASE WHEN consecutive AND isodow(last) = 5 THEN last + 2 WHEN consecutive AND isodow(last) = 6 THEN last + 1 ELSE last END AS b FROM r)
SELECT id, consecutive, CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS "end", b - a + 1 AS days FROM s""")
def long_weekend(spark, sf_dir):
    h = titled(spark, sf_dir).where(E.is_holiday(F.col("title"))).select(F.col("user_id").alias("id"), F.to_date("start").alias("day"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return E.long_weekends(h).select("id", "consecutive", text("start"), text("end"), F.col("days").cast("long").alias("days"))


@query(f"""WITH {_T}, h AS (SELECT DISTINCT start::DATE AS day, 1 AS off FROM e WHERE contains(title, '國慶日放假')), t AS (SELECT user_id AS id, min(start::DATE) AS first FROM e GROUP BY user_id),
o AS (SELECT id, unnest(generate_series(first::TIMESTAMP, (first + 119)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS day FROM t)
SELECT id, count(*) AS n, count(off) AS n_excluded, coalesce(string_agg(CASE WHEN off = 1 THEN CAST(day AS VARCHAR) END, ',' ORDER BY day), '') AS exdates FROM o LEFT JOIN h USING (day) GROUP BY id""")
def recurrence_exdates(spark, sf_dir):
    e = titled(spark, sf_dir)
    holidays = e.where(F.col("title").contains("國慶日放假")).select(F.to_date("start").alias("day"))
    terms = e.groupBy(F.col("user_id").alias("id")).agg(F.min(F.to_date("start")).alias("first"))
    return E.recurrence(terms, holidays)


@query(f"WITH {_E}, g AS (SELECT *, lag(start) OVER (PARTITION BY user_id, title ORDER BY start, event_id) AS before FROM e) SELECT event_id, user_id FROM g WHERE epoch_us(start) - epoch_us(before) <= 3600 * 1000000::BIGINT")
def duplicate_events(spark, sf_dir):
    return E.duplicates(events(spark, sf_dir), 3600).select("event_id", "user_id")


@query(f"WITH {_E} SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(start) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def rate_window(spark, sf_dir):
    return E.rate(events(spark, sf_dir), 3_600_000_000, ["user_id"]).select("event_id", "n", F.round("total", 4).alias("total"))


@query(f"WITH {_E} SELECT event_id, (epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY user_id ORDER BY start, event_id))) / 1000000.0 < 10 AS cooling FROM e")
def cooldown_gap(spark, sf_dir):
    before = F.lag("start").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    return events(spark, sf_dir).select("event_id", (((F.unix_micros("start") - F.unix_micros(before)) / 1e6) < 10).alias("cooling"))


@query(f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, epoch_us(start) AS at, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS n FROM e),
s AS (SELECT a.user_id, a.n, min(b.n) AS following FROM o a JOIN o b ON a.user_id = b.user_id AND b.n > a.n AND b.at - a.at >= 43200000000 GROUP BY ALL),
c AS (SELECT user_id, 1::BIGINT AS n FROM o WHERE n = 1 UNION ALL SELECT c.user_id, s.following FROM c JOIN s USING (user_id, n))
SELECT event_id, user_id, c.n IS NOT NULL AS accepted FROM o LEFT JOIN c USING (user_id, n)""")
def cooldown_accepts(spark, sf_dir):
    """Half a day must lie between a user's accepted requests; those refused do not count."""
    return E.cooled(events(spark, sf_dir), 43_200_000_000).select("event_id", "user_id", "accepted")


@query(f"""WITH {_E}, g AS (SELECT *, CASE WHEN epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY user_id ORDER BY start)) < 43200000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(start)) AS started, epoch_us(max(start)) + 43200000000 AS ended, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_ttl(spark, sf_dir):
    s = E.sessions(events(spark, sf_dir), "12 hours")
    return s.select("user_id", F.unix_micros("start").alias("started"), F.unix_micros("end").alias("ended"), "n")


@query(f"WITH {_E} SELECT event_id, title FROM e WHERE contains(props, '1') ORDER BY start, event_id LIMIT 30")
def owned_events(spark, sf_dir):
    """Events with the owner's tag, earliest first."""
    e = events(spark, sf_dir).where(F.col("props").contains("1"))
    return e.orderBy("start", "event_id").limit(30).select("event_id", "title")


_WEEKDAY = "(isodow(start) - 1)"


@query(f"""WITH {_E} SELECT event_id, CAST(start::DATE + 1 AS VARCHAR) || '開會' AS tomorrow, CAST(start::DATE + 3 AS VARCHAR) AS far, CAST(start::DATE + cast((2 - {_WEEKDAY} + 7) % 7 AS INT) AS VARCHAR) AS wednesday, CAST(start::DATE + cast((2 - {_WEEKDAY} + 7) % 7 + 7 AS INT) AS VARCHAR) AS next_wednesday FROM e""")
def relative_dates(spark, sf_dir):
    day = F.to_date("start")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return events(spark, sf_dir).select("event_id", D.relative_day(F.lit("明天開會"), day).alias("tomorrow"), D.relative_day(F.lit("大後天"), day).alias("far"), text(D.next_weekday(day, F.lit(2))).alias("wednesday"), text(D.weekday_of_next_week(day, F.lit(2))).alias("next_wednesday"))


@query(f"WITH {_E} SELECT event_id, month(start) || '月' || day(start) || '日(週' || substr('一二三四五六日', isodow(start)::INT, 1) || ')' AS label, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'nonsense' ELSE CAST(start::DATE AS VARCHAR) END AS DATE) IS NOT NULL AS valid FROM e")
def date_labels(spark, sf_dir):
    day = F.when(F.col("event_id") % 3 == 0, "nonsense").otherwise(F.date_format("start", "yyyy-MM-dd"))
    return events(spark, sf_dir).select("event_id", D.date_label(F.to_date("start")).alias("label"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull().alias("valid"))


@query(f"""WITH {_E}, x AS (SELECT event_id, start, event_id % 4 = 0 AS all_day, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN start - INTERVAL 1 HOUR ELSE start + INTERVAL 30 MINUTE END AS "end" FROM e),
r AS (SELECT event_id, start, all_day, CASE WHEN "end" IS NULL THEN CASE WHEN all_day THEN start + INTERVAL 1 DAY ELSE start + INTERVAL 2 HOUR END WHEN "end" <= start THEN CASE WHEN all_day THEN start + INTERVAL 1 DAY ELSE start + INTERVAL 1 HOUR END ELSE "end" END AS "end" FROM x)
SELECT event_id, epoch_us("end") AS "end", epoch_us(start + INTERVAL 3 DAY + ("end" - start)) AS moved FROM r""")
def interval_repair(spark, sf_dir):
    hour = F.make_interval(hours=F.lit(1))
    end = F.when(F.col("event_id") % 3 == 1, F.col("start") - hour).when(F.col("event_id") % 3 == 2, F.col("start") + F.make_interval(mins=F.lit(30)))
    e = events(spark, sf_dir).withColumn("fixed", D.repaired_end(F.col("start"), end, F.col("event_id") % 4 == 0))
    moved = E.moved_end(F.col("start"), F.col("fixed"), F.col("start") + F.make_interval(days=F.lit(3)), F.lit(None))
    return e.select("event_id", F.unix_micros("fixed").alias("end"), F.unix_micros(moved).alias("moved"))


@query(f"""WITH {_E}, first AS (SELECT event_id FROM e WHERE start BETWEEN TIMESTAMP '2025-06-01' AND TIMESTAMP '2025-06-02'), wide AS (SELECT event_id FROM e WHERE contains(title, 'click') AND start BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-06-28')
SELECT event_id FROM first UNION ALL SELECT event_id FROM wide WHERE (SELECT count(*) FROM first) = 0""")
def search_window_fallback(spark, sf_dir):
    """The wide window, half a year either way of the day of the request, counts only if the narrow one is empty."""
    request = "1 AS request_id, 'click' AS keyword, date'2025-06-01' AS target_day, cast(NULL AS timestamp) AS target_time, date'2024-06-29' AS today, false AS include_past"
    e = events(spark, sf_dir).select("event_id", "start", F.when(F.col("title").contains("click"), F.array(F.lit("click"))).alias("words"))
    return E.found_in_window(e, spark.sql(f"SELECT {request}")).select("event_id")


@query(f"""WITH {_E}, r AS (SELECT event_id AS request_id, event_id % 3 AS k, start::DATE AS d, start, title FROM e WHERE event_id % 100 = 0),
h AS (SELECT request_id, event_id, CASE k WHEN 0 THEN e.start::DATE = d WHEN 1 THEN e.start >= r.start - INTERVAL 1 HOUR AND e.start < r.start + INTERVAL 1 HOUR ELSE e.start >= d END AS exact, k
      FROM r JOIN e ON k = 0 OR e.title = r.title)
SELECT request_id, event_id FROM h QUALIFY exact OR (k = 1 AND NOT bool_or(exact) OVER (PARTITION BY request_id))""")
def events_in_windows(spark, sf_dir):
    """Every hundredth event asks for all events of its day, for its own title around its time, or from its day on."""
    e, key = events(spark, sf_dir), F.col("event_id")
    kind, day = key % 3, F.to_date("start")
    requests = e.where(key % 100 == 0).select(
        key.alias("request_id"), F.when(kind == 0, "*").otherwise(F.col("title")).alias("keyword"), F.when(kind == 0, day).alias("target_day"), F.when(kind == 1, F.col("start")).alias("target_time"), day.alias("today"), F.lit(False).alias("include_past")
    )
    return E.found_in_window(e.select("event_id", "start", F.array("title").alias("words")), requests)


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 7 + 1 WHEN 1 THEN o_custkey % 7 + 1 ELSE isodow(o_orderdate) END AS INT) AS weekday FROM orders""")
def weekday_argument(spark, sf_dir):
    """A digit, a spoken weekday, or neither: then the order's own."""
    key, day = F.col("o_orderkey"), F.get(F.array(*[F.lit(c) for c in lexicon.WEEKDAYS]), (F.col("o_custkey") % 7).cast("int"))
    word = F.concat(F.get(F.array(F.lit("星期"), F.lit("禮拜"), F.lit("週")), (F.col("o_custkey") % 3).cast("int")), F.when((day == "日") & (key % 8 == 1), "天").otherwise(day))
    text = F.when(key % 4 == 0, F.concat(F.lit(" "), (key % 7 + 1).cast("string"))).when(key % 4 == 1, word).when(key % 4 == 2, "8").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.weekday_argument(text, F.col("o_orderdate").cast("date")).alias("weekday"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 2 THEN CAST(d + 7 AS VARCHAR) END AS midterm, CASE WHEN k > 0 THEN CAST(d + 20 AS VARCHAR) END AS final_end FROM o""")
def progress_dates(spark, sf_dir):
    """Weeks of a progress table whose rows name the midterm and the final, if any does."""
    key = F.col("o_orderkey")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "yyyy/MM/dd")
    week = lambda n, word: F.concat(F.lit(f"第{n + 7}週課程 ("), day(7 * n), F.lit("─"), day(7 * n + 6), F.lit(")："), word, F.lit("\n"))
    text = F.concat(week(0, F.lit("緒論")), week(1, F.when(key % 3 == 0, "期中考").when(key % 3 == 1, "Midterm").otherwise("導論")), week(2, F.when(key % 3 == 0, "實作").otherwise("期末報告")))
    iso = lambda kind, end: F.date_format(E.progress_week(text, kind)[end], "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", iso("midterm", "start").alias("midterm"), iso("final", "end").alias("final_end"))
