import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import events as E
from marlstone.operators import inject as I
from marlstone.plans import route as R


def test_backfill_of_one_and_of_all_professors(spark):
    rows = [(1, "professor_info", "王小明"), (2, "professor_info", "王小明"), (3, "professor_info", "未知教授"), (4, "professor_info", None), (5, "facility_info", ""), (6, "professor_info", "李四"), (7, "dept_intro", "李四"), (8, None, "王小明")]
    chunks, found = spark.createDataFrame(rows, "node_id long, info_type string, teacher string"), spark.createDataFrame([(1,), (1,)], "node_id long")
    assert [tuple(r) for r in I.backfill(chunks, found, "小明").collect()] == [(2, 1.0, 10.0, "context_backfill")]
    assert {(r.node_id, r.source) for r in I.backfill(chunks, found).collect()} == {(2, "general_prof_backfill"), (6, "general_prof_backfill"), (5, "general_facility_backfill")}
    assert I.backfill(chunks.limit(0), found).count() == 0 and I.backfill(chunks, found.limit(0), "沒有").count() == 0
    assert {r.node_id for r in I.chunks_of(chunks, found, ["王小明"]).collect()} == {2, 8}


def test_courses_of_teachers_are_bounded(spark):
    rows = [("甲、乙", f"c{n:02}") for n in range(30)] + [("甲", "c00"), (None, "c99")]
    got = I.courses_of(spark.createDataFrame(rows, "teacher string, course_name string"), 25).groupBy("teacher").count().collect()
    assert {(r.teacher, r["count"]) for r in got} == {("甲", 25), ("乙", 25)}


@pytest.mark.parametrize("question,words", [
    ("英文系", "應英系 應用英語學系 英文課 英文老師"), (" CSIE ", "資工系 資工老師 資訊工程學系 資工"), ("csie老師", "資工系 資工老師 資訊工程學系 資工"), ("護理系", "護理系"),
    ("AB老師", "王小明"), ("ab", "王小明"), ("abc", "abc"), ("", ""), (None, None),
])
def test_names_without_an_ending_and_nicknames(spark, question, words):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(R.opinion_query(F.col("q"), {"ab": "王小明"})).first()[0] == words


def test_requests_for_everything_meet_by_day(spark):
    day = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
    events = spark.createDataFrame([(n, "t", day + dt.timedelta(days=n), ["t"]) for n in range(40)] + [(99, "t", None, ["t"])], "event_id long, title string, start timestamp, words array<string>")
    none, today = None, day.date()
    asked = [(1, "*", today + dt.timedelta(days=5), none, today, False), (2, "*", none, none, today + dt.timedelta(days=38), False), (3, "*", dt.date(2030, 1, 1), none, today, False), (4, "*", none, none, today, True), (5, "t", dt.date(2030, 1, 1), none, today, False)]
    requests = spark.createDataFrame(asked, "request_id int, keyword string, target_day date, target_time timestamp, today date, include_past boolean")
    got = {}
    for r in E.found_in_window(events, requests).collect():
        got.setdefault(r.request_id, set()).add(r.event_id)
    assert got == {1: {5}, 2: {38, 39}, 4: set(range(40)), 5: set(range(40))}
    assert E.found_in_window(events.limit(0), requests).count() == 0


def test_requests_of_all_kinds_find_what_a_plain_loop_finds(spark):
    day = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
    events = [(n, day + dt.timedelta(hours=7 * n), [["t"], ["t", "u"], ["u", "*"], None][n % 4]) for n in range(60)] + [(99, None, ["t"])]
    today, none = day.date(), None
    asked = [(k, word, today + dt.timedelta(days=k) if k % 3 == 0 else none, day + dt.timedelta(days=k) if k % 3 == 1 else none, today + dt.timedelta(days=k % 5), k % 2 == 0) for k in range(24) for word in (["t", "u", "*", "none"][k % 4],)]
    asked += [(50, "t", dt.date(2026, 9, 1), none, dt.date(2026, 8, 28), False), (51, "u", none, day - dt.timedelta(days=3), today, False), (52, "t", none, none, none, False)]
    expected = []
    for key, word, on, at, now, past in asked:
        midnight = lambda d: dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc)
        low = midnight(on) if on else at - dt.timedelta(hours=1) if at else midnight(now) - dt.timedelta(days=180 * past) if now else None
        high = midnight(on) + dt.timedelta(days=1) if on else at + dt.timedelta(hours=1) if at else None
        held = [(n, s) for n, s, words in events if s and (word == "*" or word in (words or []))]
        hits = [n for n, s in held if low and s >= low and (high is None or s < high)]
        if not hits and (on or at) and word != "*":
            hits = [n for n, s in held if abs(s - midnight(now)) <= dt.timedelta(days=180)]
        expected += [(key, n) for n in hits]
    requests = spark.createDataFrame(asked, "request_id int, keyword string, target_day date, target_time timestamp, today date, include_past boolean")
    found = E.found_in_window(spark.createDataFrame([(n, "x", s, w) for n, s, w in events], "event_id long, title string, start timestamp, words array<string>"), requests)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # hits are as many as requests times events: they must not be shuffled


def shuffled(spark):
    """Rows shuffled by the session so far."""
    jvm = spark._jvm
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_requests_of_many_days_are_shuffled_once_a_deal(spark):
    events = spark.range(2000).selectExpr("id AS event_id", "'x' AS title", "timestamp'2020-01-01 12:00:00' + make_dt_interval(cast(id AS int)) AS start", "array('t') AS words")
    requests = spark.range(200).selectExpr("id AS request_id", "'t' AS keyword", "cast(NULL AS date) AS target_day", "cast(NULL AS timestamp) AS target_time", "date'2020-01-01' AS today", "false AS include_past")
    before = shuffled(spark)
    assert E.found_in_window(events, requests).count() == 2000 * 200
    assert shuffled(spark) - before < 50_000


def test_hits_take_little_room_in_a_file(spark, tmp_path):
    events = spark.range(256).selectExpr("id AS event_id", "'x' AS title", "timestamp'2026-01-05 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) AS start", "array('t') AS words")
    requests = spark.range(25_000).selectExpr("id AS request_id", "'t' AS keyword", "cast(NULL AS date) AS target_day", "cast(NULL AS timestamp) AS target_time", "date'2026-01-04' AS today", "false AS include_past")
    E.found_in_window(events, requests).write.parquet(str(tmp_path / "hits"))
    found = spark.read.parquet(str(tmp_path / "hits")).groupBy("event_id").agg(F.count("*").alias("n"), F.min("request_id").alias("least"), F.max("request_id").alias("most"))
    assert [tuple(r)[1:] for r in found.collect()] == [(25_000, 0, 24_999)] * 256
    assert sum(f.stat().st_size for f in (tmp_path / "hits").glob("*.parquet")) < 256 * 25_000 / 2
