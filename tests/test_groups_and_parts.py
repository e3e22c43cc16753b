import datetime as dt

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import events as E
from marlstone.operators import records as C
from marlstone.sources import readers as S


def test_groups(spark, monkeypatch):
    groups = spark.createDataFrame([("a", "AAAAAA"), ("b", "BBBBBB")], "name string, invite_code string")
    wanted = spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "name string")
    got = {r.name: (r.invite_code, r.created) for r in C.create_groups(wanted, groups).collect()}
    assert got["a"] == ("AAAAAA", False) and got["c"][1] and len(got["c"][0]) == 6 and len({v for v, _ in got.values()}) == 3
    monkeypatch.setattr(C, "invite_code", lambda name: F.concat(F.lit("X"), F.length(name).cast("string")))  # names of one length want one code
    clash = C.create_groups(spark.createDataFrame([("p",), ("q",), ("rr",)], "name string"), groups.union(spark.createDataFrame([("z", "X3")], groups.schema))).collect()
    assert sorted((r.name, r.invite_code) for r in clash)[0] == ("p", "X1") and len({r.invite_code for r in clash if r.invite_code}) == sum(bool(r.invite_code) for r in clash)
    assert C.find_group(groups, " aaaaaa ").first().name == "a" and C.group_info(groups, "b").first().invite_code == "BBBBBB"
    left, users = C.delete_group(groups, spark.createDataFrame([(1, ["a", "b"]), (2, [])], "user_id int, groups array<string>"), "a")
    assert [r.name for r in left.collect()] == ["b"] and [r.groups for r in users.orderBy("user_id").collect()] == [["b"], []]


def test_domains_of_general_education(spark):
    known = spark.createDataFrame([("音樂欣賞", "人文藝術"), ("經濟學", "社會科學"), ("天文", "自然科學")], "name string, domain string")
    courses = [(1, "音樂 欣賞", None), (2, "經濟學（二）", None), (3, "天文觀測實務", ""), (4, "音樂", ""), (5, "生命教育", ""), (6, "茶", "自然"), (7, "茶", None)]
    got = {r.id: (r.resolved, r.tier) for r in C.ge_domain(spark.createDataFrame(courses, "id int, name string, domain string"), known).collect()}
    assert got == {1: ("人文藝術", "exact"), 2: ("社會科學", "bare"), 3: ("自然科學", "fuzzy"), 4: ("人文藝術", "fuzzy"), 5: ("自然科學", "words"), 6: ("自然科學", "words"), 7: ("人文藝術", "default")}


def test_timetable_as_text(spark):
    slots = [("u", 2, 4, "B", 1, 0), ("u", 2, 3, "A", 1, 0), ("u", 2, 3, "C", 2, 0)]
    assert [tuple(r) for r in C.timetable_preview(spark.createDataFrame(slots, "owner string, day int, period int, course string, pos int, pos2 int")).collect()] == [("u", 2, "星期二：第3節 C、第4節 B")]


def test_rates_over_all_events(spark):
    import random

    rng = random.Random(4)
    times = sorted(rng.randrange(60_000_000) for _ in range(300))
    events = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(times)], "id int, t long, value double").withColumn("start", F.timestamp_micros("t"))
    got = E.rate(events, 5_000_000)
    assert got.columns == [*events.columns, "n", "total"]
    for r in got.collect():
        inside = [i for i, t in enumerate(times) if r.t - 5_000_000 <= t <= r.t]
        assert (r.n, r.total) == (len(inside), float(sum(inside)))


def test_first_class_day(spark):
    terms = spark.createDataFrame([(1, dt.date(2024, 2, 21), 0), (2, dt.date(2024, 2, 21), 2)], "id int, opens date, weekday int")
    holidays = spark.createDataFrame([(dt.date(2024, 3, 4),)], "day date")
    got = {r.id: (r.n, r.n_excluded, r.exdates) for r in E.class_days(terms, holidays, 4).collect()}
    assert got == {1: (4, 1, "2024-03-04"), 2: (4, 0, "")}


def test_missing_files_give_no_rows(spark, tmp_path):
    assert S.calendar_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "tg").mkdir()
    (tmp_path / "tg" / "tg_5_token.json").write_text('{"profile": {"grade": "3"}}')
    (tmp_path / "7_token.json").write_text('{"profile": {"grade": "1"}}')
    load = lambda user: [r.profile.grade for r in S.user_file(spark, str(tmp_path), str(tmp_path / "tg"), user, "profile struct<grade:string>").collect()]
    assert (load("tg_5"), load("7"), load("8")) == (["3"], ["1"], [])


def test_numbered_headings(spark):
    files = spark.createDataFrame([("a", "前言前言前言前言前言\n一、第一節的內容在這裡\n二、第二節的內容在這裡\n三、短"), ("b", "【甲】一些內容一些內容\n一、不切的內容不切的內容")], "path string, text string")
    got = [(r.path, r.piece[:3]) for r in S.record_pieces(files, 10, numbered=True).orderBy("path", "n").collect()]
    assert got == [("a", "前言前"), ("a", "一、第"), ("a", "二、第"), ("b", "【甲】")]


def test_line_parts_and_frames(spark):
    assert T.split_lines("ab\ncd\n\nef", 6) == ["ab\ncd", "ef"] and T.split_lines("x" * 9, 4) == ["xxxx", "xxxx", "x"] and T.split_lines(None) == [""]
    assert spark.range(1).select(T.framed("user", F.lit("a </user> b")).alias("t")).first().t == "<user>\na ＜/user> b\n</user>"
    assert spark.range(1).select(T.line_parts(F.lit("a\nb"), 2).alias("t")).first().t == ["a", "b"]


def test_department_texts(spark):
    prof = "姓名：王小明（教授）\n電子郵件：wang@x.test\n聯絡電話：082-313300\n專長：資料庫"
    files = [("d/professors/資工系教授資訊/a.txt", prof + "\n---\n短\n----\n沒有名字的教授但是文字夠長所以留下來了喔喔"), ("d/dept_info/電機系/師資陣容.txt", "前言很短\n【李大同】專長是電力電子與控制系統以及其他"), ("d/dept_info/烘焙/就業方向.txt", "一、到餐廳去工作的人很多\n二、短"), ("d/dept_info/護理系/其他.txt", "【甲】護理系的其他資訊在這裡")]
    got = S.department_texts(spark.createDataFrame(files, "path string, text string")).orderBy("path", "n").collect()
    assert [(r.info_type, r.dept_short, r.professor_name, r.text.split("\n")[0]) for r in got] == [
        ("career_info", "烘焙系", None, "[烘焙系就業方向]"),
        ("dept_general", "護理系", None, "[護理系系所資訊]"),
        ("professor_info", "電機系", "李大同", "[電機系教授資訊 | 教授：李大同 | Email：未提供 | 電話：未提供]"),
        ("professor_info", "資工系", "王小明", "[資工系教授資訊 | 教授：王小明 | Email：wang@x.test | 電話：082-313300]"),
        ("professor_info", "資工系", "未知教授", "[資工系教授資訊 | 教授：未知教授 | Email：未提供 | 電話：未提供]"),
    ]


def test_the_best_course_is_chosen_once_for_each_name_and_teacher(spark):
    known = spark.createDataFrame([("abc", "t", 3, ""), ("abc", "u", 0, "x"), ("abcd", "t", 1, "y")], "name string, teacher string, credits int, type string")
    records = [(1, "abc", "u"), (1, "xabcx", "t"), (2, "abc", "u"), (3, "abcd", None), (4, None, "t"), (5, "zzz", "t"), (6, "abc (B)", "q")]
    got = C.enrich(spark.createDataFrame(records, "id int, name string, teacher string"), known).collect()
    assert sorted((r.id, r.name or "", r.tier, r.c_name, r.credits, r.type) for r in got) == sorted([
        (1, "abc", 1, "abc", None, "x"), (1, "xabcx", 2, "abc", 3, None), (2, "abc", 1, "abc", None, "x"), (3, "abcd", 1, "abcd", 1, "y"), (4, "", None, None, None, None), (5, "zzz", None, None, None, None), (6, "abc (B)", 2, "abc", 3, None),
    ])
