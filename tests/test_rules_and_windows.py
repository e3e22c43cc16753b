import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import events as E
from marlstone.plans import route as R
from marlstone.sources import readers as S

RULES = {
    "_description": "畢業門檻", "department": "資工系", "total_required": 130,
    "categories": {
        "系必修": {"required_credits": 51, "note": "含實驗", "courses": [{"name": "C1", "credits": 3, "hours": 4, "year": 1, "semester": 2, "note": "x"}, "C2", {"credits": 1}]},
        "通識": {"required_credits": 12, "domains": {"人文": {"min_credits": 4}, "社會": {}}},
        "專業選修": {"max_from_other_dept": 9, "courses": [], "tracks": {"T1": {"courses": ["C3", {"name": "C4", "credits": 2}]}, "T2": {"courses": []}}},
    },
    "graduation_conditions": ["英檢", "實習"],
}
TEXT = """[資工系 畢業門檻]
# 畢業門檻
**適用系所**：資工系
**畢業學分門檻**：130 學分

## 系必修 (51 學分) - 含實驗
- C1 (3學分 (4小時)) [大1, 第2學期] (備註: x)
- C2
- 未命名課程 (1學分)
## 通識 (12 學分)
- 人文領域：至少 4 學分
- 社會領域：至少 0 學分
## 專業選修 (0 學分)
- 【注意】可承認外系(所)學分上限：9 學分
### T1
- 包含課程：C3, C4 (2學分)

### T2
## 其他畢業條件
- 英檢
- 實習"""


def test_rules_as_text(spark):
    files = [("d/資工_graduation.json", json.dumps(RULES, ensure_ascii=False)), ("d/leave.json", "{}"), ("d/bad.json", "not json"), ("d/list.json", "[1]"), ("d/none.json", None)]
    got = {r.path: r for r in S.rule_texts(spark.createDataFrame(files, "path string, json string")).collect()}
    assert got.keys() == {"d/資工_graduation.json", "d/leave.json"}
    assert got["d/資工_graduation.json"].text == TEXT and got["d/資工_graduation.json"].info_type == "graduation_rules"
    assert got["d/leave.json"].text == "[全校 系統規章]\n# 系統規章\n**適用系所**：全校\n**畢業學分門檻**：0 學分\n" and got["d/leave.json"].category == "系統規章"


def test_rule_file_of_a_department(spark):
    names = ["z_graduation_資工.json", "leave_資工.json", "電機_畢業.json", "a_Graduation.json"]
    df = spark.createDataFrame([("資工系", "資訊工程學系"), ("電機", None), ("護理系", "護理學系"), (None, None), ("", "")], "a string, b string")
    assert [r.f for r in df.select(S.rule_file(F.col("a"), F.col("b"), names).alias("f")).collect()] == ["z_graduation_資工.json", "電機_畢業.json", *["a_Graduation.json"] * 3]
    assert df.select(S.rule_file(F.col("a"), F.col("b"), ["leave.json"]).alias("f")).first().f is None


@pytest.mark.parametrize("said,expected", [
    ('```json\n{"a": 1,}\n```', {"a": 1}), ('Here: {"a": [1, 2,], "b": {"c": "x"', {"a": [1, 2], "b": {"c": "x"}}), ('{"a": "it } says, \\" ok', {"a": 'it } says, " ok'}), ('{"a": 1} and so on', {"a": 1}), ("nothing", None), (None, None),
])
def test_json_is_mended(spark, said, expected):
    df = spark.createDataFrame([(said,)], "json string")
    mended = df.select(S.repaired_json(F.col("json")).alias("j")).first().j
    assert (json.loads(mended) if expected else mended) == (expected or said)
    good, bad = S.json_records(df, "a string")
    assert (good.count(), bad.count()) == ((1, 0) if expected else (0, 1))


@pytest.mark.parametrize("question,year", [("資工三有什麼課", "三"), ("電機二甲的課", "二"), ("資工系大一", "一"), ("資工有什麼課", None), ("三有什麼課", None), ("碩二的課", "碩二")])
def test_year_behind_a_short_name(spark, question, year):
    assert spark.range(1).select(R.grade(F.lit(question)).alias("g")).first().g == year


def test_courses_taken_for_teachers_move():
    got = R.repaired({"teacher": ["嵌入式系統概論", "王小明老師", "E320", "作業系統"], "course_name_keyword": ["微積分"]}, teachers=frozenset({"作業系統"}))
    assert got == {"teacher": ["王小明", "作業系統"], "course_name_keyword": ["微積分", "嵌入式系統概論"]}
    assert R.repaired({"teacher": ["Linux"]}, courses=frozenset({"Linux"})) == {"course_name_keyword": ["Linux"]}
    assert R.repaired({"teacher": None, "x": ["1"]}) == {"teacher": None, "x": ["1"]}


def test_decisions():
    term = ("114", "2")
    failed = R.decide("q", "course_info", {"grade": ["一"]})
    assert (failed.confidence, failed.search_queries, failed.filters.wanted) == (0.3, ("q",), {"grade": ["一"]})
    timed = R.decide("星期三有什麼課", "course_info", {"day_of_week": ["星期三"]}, {"filters": {"semester": None}, "search_queries": ["a", "a"]}, term=term, profile={"department": "資工系", "grade": "3"})
    assert timed.filters.wanted == {"day_of_week": ["星期三"], "academic_year": ["114"], "semester": ["2"], "dept_short": ["資工系"], "grade": ["三"]}
    assert (timed.confidence, timed.search_queries) == (0.9, ("星期三有什麼課", "a"))
    topic = R.decide("Linux相關的內容", "course_info", {"grade": ["二"]}, {"filters": {"course_name_keyword": ["Linux"]}}, term=term, profile={"department": "資工系"})
    assert topic.filters.wanted == {"course_name_keyword": ["Linux"]}
    career = R.decide("今天想轉職", "course_info", {}, {"is_career_planning": True, "filters": {}}, term=term)
    assert career.filters.wanted == {} and career.confidence == 0.7 and career.is_career_planning


@pytest.mark.parametrize("question,words", [("英文老師", "應英系 英文老師 大一英文 英文課 應用英語學系"), ("資管系教授", "資管系 資管老師 資管課"), ("王小明老師", "王小明 老師 評價 王小明 教授"), ("演算法與資料結構課", "演算法與資料結構 老師 演算法與資料結構 課"), ("宿舍", "宿舍")])
def test_opinion_queries(spark, question, words):
    assert spark.range(1).select(R.opinion_query(F.lit(f" {question} ")).alias("q")).first().q == words


def test_copies_with_our_tag(spark):
    at = lambda m, d, h=9: dt.datetime(2024, m, d, h)
    stored = [("exam", at(3, 5), at(3, 5, 11), "own"), ("class", at(5, 1), at(5, 1, 10), "own"), ("exam", at(3, 9), None, "theirs")]
    wanted = [(1, "exam", at(3, 5, 14), at(3, 5, 15), False), (2, "exam", at(3, 6), at(3, 6), False), (3, "class", at(2, 20), at(2, 20), True), (4, "class", at(2, 20), at(2, 20), False), (5, "exam", at(3, 9), at(3, 9), False)]
    found = E.copies_of(spark.createDataFrame(wanted, "id int, title string, start timestamp, end timestamp, recurring boolean"), spark.createDataFrame(stored, "title string, start timestamp, end timestamp, tag string"), "own")
    assert sorted(r.id for r in found.collect()) == [1, 3]


def test_windows_and_their_fallback(spark):
    at = lambda m, d, h=9: dt.datetime(2024, m, d, h)
    events = spark.createDataFrame([(1, at(3, 5), ["exam", "*"]), (2, at(6, 1), ["exam", "*"]), (3, at(1, 2), ["party", "*"])], "event_id int, start timestamp, words array<string>")
    day = dt.date(2024, 3, 1)
    asked = [(1, "exam", dt.date(2024, 3, 5), None, day, False), (2, "exam", None, at(6, 1, 10), day, False), (3, "party", dt.date(2024, 3, 5), None, day, False), (4, "exam", None, None, day, False), (5, "party", None, None, day, False), (6, "party", None, None, day, True), (7, "*", dt.date(2024, 3, 6), None, day, False)]
    got = E.found_in_window(events, spark.createDataFrame(asked, "request_id int, keyword string, target_day date, target_time timestamp, today date, include_past boolean")).collect()
    assert sorted((r.request_id, r.event_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 1), (4, 2), (6, 3)]


def test_moved_events_keep_their_length(spark):
    t = "timestamp'2024-01-01 09:00:00'"
    cases = [(f"{t} + interval 3 hours", "cast(null as timestamp)", 3), (f"{t} + interval 30 seconds", "cast(null as timestamp)", 2), ("cast(null as timestamp)", "cast(null as timestamp)", 2), (f"{t} + interval 3 hours", f"{t} + interval 10 days 5 hours", 5)]
    for end, new_end, hours in cases:
        row = spark.range(1).select(E.moved_end(F.expr(t), F.expr(end), F.expr(f"{t} + interval 10 days"), F.expr(new_end)).alias("e")).first()
        assert row.e == dt.datetime(2024, 1, 11, 9 + hours)


def test_weeks_of_a_progress_table(spark):
    text = "第8週課程 (2026/04/13─2026/04/19)：緒論\n第9週課程 (2026/04/20─2026/04/26)：midterm exam \n第18週課程(2026/06/22─2026/06/28) : 期末考"
    row = spark.range(1).select(*[E.progress_week(F.lit(text), k).alias(k) for k in ("midterm", "final", "緒論", "a.b")]).first()
    assert (row.midterm.start, row.midterm.end, row.midterm.activity) == (dt.date(2026, 4, 20), dt.date(2026, 4, 26), "midterm exam")
    assert row.final.start == dt.date(2026, 6, 22) and row["緒論"].activity == "緒論" and row["a.b"] is None
