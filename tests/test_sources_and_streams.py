import json

from pyspark.sql import functions as F

from marlstone.operators import records
from marlstone.sources import readers as S
from marlstone.sources import sinks
from marlstone.streaming import streams


def test_text_and_course_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c1.txt").write_text("課程名稱：微積分（一）\n開課班級：資工一甲\n備註：人文\n課程教學目標：甲\n教科書資料：乙\n課程教學綱要：丙\n", "utf-8")
    (tmp_path / "skip.md").write_text("x")
    row = S.course_records(S.text_files(spark, str(tmp_path))).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.course_name, r.grade, r.class_group, r.teacher, r.ge_domain, r.semester) == ("微積分（一）", "一", "甲", "未知", "人文", "0")
    # the end label tried first counts, although another one comes earlier
    assert r.sections["objectives"] == "甲\n教科書資料：乙"


def test_rules_with_objects_and_names(spark, tmp_path):
    rules = {"categories": {"系必修": {"required_credits": 51, "courses": [{"name": "C1", "credits": 3}, "C2"]}, "空": {"required_credits": 1}}}
    (tmp_path / "r.json").write_text(json.dumps(rules, ensure_ascii=False), "utf-8")
    rows = {(r.category, r.course) for r in S.rule_lines(spark, str(tmp_path / "r.json")).collect()}
    assert rows == {("系必修", "C1（3學分）"), ("系必修", "C2"), ("空", None)}


def test_users_events_and_bad_json(spark, tmp_path):
    (tmp_path / "tg_7_token.json").write_text('{"profile": {"grade": "三"}}', "utf-8")
    (tmp_path / "other.json").write_text("{}")
    users = S.user_files(spark, str(tmp_path), "profile struct<grade:string>").collect()
    assert [(u.user_id, u.platform, u.document.profile.grade) for u in users] == [("tg_7", "telegram", "三")]
    (tmp_path / "e.json").write_text('[{"title": "開學", "start": "2026-02-20T00:00:00", "end": "bad"}]', "utf-8")
    e = S.calendar_file(spark, str(tmp_path / "e.json")).first()
    assert e.title == "開學" and e.start.day == 20 and e.end is None
    texts = spark.createDataFrame([(1, '{"transcript": {"gpa": 80}}'), (2, '{"gpa": 70}'), (3, "{oops")], "id int, json string")
    good, bad = S.json_records(texts, "gpa int")
    assert {(r.id, r.record.gpa) for r in good.collect()} == {(1, 80), (2, 70)} and [r.id for r in bad.collect()] == [3]


def test_terms(spark):
    days = spark.createDataFrame([("2025-09-01",), ("2026-01-10",), ("2026-03-01",)], "d string").select(S.default_term(F.to_date("d")).alias("t"))
    assert [r.t for r in days.collect()] == ["114-1", "114-1", "114-2"]


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert sinks.current(spark, folder) is None
    sinks.publish(spark.range(3).toDF("id"), folder)
    sinks.publish(spark.range(5).toDF("id"), folder)
    assert sinks.current(spark, folder).count() == 5
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_free_and_busy_cover_the_grid(spark):
    s = spark.createDataFrame([(1, 1, 2, 5, 1, 1), (1, 1, 4, 5, 2, 1), (1, 1, 2, 6, 3, 1), (2, 7, 13, 9, 1, 1)], "owner long, day int, period int, course long, pos long, pos2 long")
    free = records.free_slots(s).groupBy("owner").agg(F.sum("n_free").alias("n")).collect()
    assert {(r.owner, r.n) for r in free} == {(1, 89), (2, 90)}
    assert {(r.day, r.period, r.course) for r in records.last_write(s).where("owner = 1").collect()} == {(1, 2, 6), (1, 4, 5)}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("start"), "value")
    folder = str(tmp_path / "in")
    e.repartition(3).write.parquet(folder)
    schema = "event_id long, user_id long, start timestamp, value double"
    stream = streams.event_stream(spark, folder, schema)
    got = streams.once(streams.idle_sessions(stream, "12 hours", "400 days"), "sessions", str(tmp_path / "c1"), "complete")
    from marlstone.operators import events

    assert got.count() == events.sessions(e, "12 hours").count()
    rate = streams.once(streams.request_rate(streams.event_stream(spark, folder, schema), "1 hour", "400 days"), "rates", str(tmp_path / "c2"), "complete")
    assert rate.agg(F.sum("n")).first()[0] == e.count()
    q = streams.answer_stream(streams.event_stream(spark, folder, schema), lambda rows: rows.select("event_id", F.lit("answer").alias("a")), str(tmp_path / "audit"), str(tmp_path / "c3"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == e.count()
