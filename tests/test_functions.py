import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.functions import text as T
from marlstone.operators import match as M
from marlstone.operators import retrieve as R
from marlstone.plans import route


@pytest.mark.parametrize("text,number", [("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("二十三", 23), ("三十一", 31), ("二三", 23), ("16", 16), ("", 0), ("拾伍", 15)])
def test_han_numbers(text, number):
    assert D.han_number(text) == number


@pytest.mark.parametrize("said,written", [
    ("三月十六號", "3月16號"), ("3/十六", "3/16"), ("三月16日", "3月16日"), ("九點半", "9點半"), ("下午三點十分", "15點10分"), ("第五節到第七節", "第5節到第7節"),
    ("明天十點", "2024-01-02 10點".replace(" ", "")), ("大後天", "2024-01-04"), ("三天後", "2024-01-04"), ("下週三", "2024-01-10"), ("早上九點到一點", "9點到13點"), ("禮拜三", "星期三"), ("", ""), (None, None),
])
def test_dates_in_text(said, written):
    assert D.normalise_text(said, dt.date(2024, 1, 1)) == written


def test_messages_are_cut_at_edges_and_keep_their_text():
    text = "\n\n".join("para %d " % i + "word " * 40 for i in range(30))
    parts = T.split_message(text, 500)
    assert all(len(p) <= 500 for p in parts) and "".join(parts).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    fenced = T.split_message("```\n" + "x = 1\n" * 200 + "```", 300)
    assert all(p.count("```") % 2 == 0 and len(p) <= 300 for p in fenced)
    assert T.split_message("", 10) == [""] and T.split_message(None, 10) == [""]
    assert [len(p) for p in T.split_message("y" * 25, 18)] == [10, 15]


def test_spacing_keeps_code_and_links():
    assert T.space_text("用Python3寫`a中b`看https://x.test/中a") == "用 Python3 寫`a中b`看https://x.test/中a"


def test_repeated_half_goes():
    half = "這是一段很長的回答，" * 10
    assert T.drop_repeated_block(half + "\n\n" + half) == half.strip()
    other = "完全不同的內容在這裡，沒有重複。" * 8
    assert T.drop_repeated_block(half + "\n\n" + other) == half + "\n\n" + other


def test_han_runs_are_cut_into_pairs_in_chunks_and_questions(spark):
    chunks = [(1, "本課程介紹作業系統的設計，使用Python3實作。"), (2, "資料庫系統概論"), (3, "Operating systems, 2nd Ed."), (4, "茶"), (5, None), (6, "物理學實驗")]
    df = spark.createDataFrame(chunks, "node_id long, text string")
    got = {r.node_id: r.t for r in df.select("node_id", T.tokens(F.col("text")).alias("t")).collect()}
    assert got[1] == ["本", "課程", "介紹", "紹作", "作業", "業系", "系統", "統的", "的設", "設計", "使用", "python3", "實作"]
    assert got[2] == ["資料", "料庫", "庫系", "系統", "統概", "概論"]
    assert (got[3], got[4], got[5]) == (["operating", "systems", "2nd", "ed"], ["茶"], None)
    terms = df.limit(1).select(F.lit(0).alias("query_id"), F.explode(T.query_tokens(F.lit("作業系統"))).alias("term"))
    scored = R.bm25(R.keyword_index(df.where("text IS NOT NULL")), terms).orderBy(F.desc("score")).collect()
    assert [r.node_id for r in scored] == [1, 2]


def test_empty_department_matches_everything(spark):
    df = spark.createDataFrame([("", "王小明"), ("全校", "李"), ("資訊工程學系", "王小名"), ("電機系", "陳")], "dept_short string, teacher string")
    assert [r[0] for r in df.select(M.department(["資工"])).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(M.teacher(["王小明老師"])).collect()] == [True, False, True, False]


def test_periods_that_touch_and_that_do_not_parse(spark):
    df = spark.createDataFrame([("星期一第2節~第4節",), ("第4節",), ("",), ("星期一",), ("第5節~第6節",)], "schedule string")
    assert [r[0] for r in df.select(M.periods(["4-4"])).collect()] == [True, True, False, False, False]


def test_exemptions_and_weights():
    f = M.Filters({"course_name_keyword": ["a", "b"], "semester": ["1"], "grade": ["一"], "dept_short": ["x"]})
    assert set(f.exempt().wanted) == {"course_name_keyword", "dept_short"}
    assert M.Filters({"semester": ["1"], "teacher": ["x"]}).weights("semester") == (3.0, -2.0)
    assert M.Filters({"semester": ["1"]}).weights("semester") == (2.0, -100.0)
    assert "grade" not in M.Filters({"grade": ["一"]}, "大一和大二").exempt().wanted


def test_thresholds(spark):
    rows = lambda *x: spark.createDataFrame(x, "node_id long, final_score double, metadata_score double")
    assert R.relative_threshold(rows((1, 0.5, 0.0), (2, 0.01, 0.0)), 0).count() == 2  # the best is not above 0.5
    assert R.relative_threshold(rows((1, 1.0, 0.0), (2, 0.39, 0.0)), 1).count() == 1
    low = [(i, -10.1, -20.0 - i) for i in range(5)]
    assert {r.node_id for r in R.relative_threshold(rows(*low), 0).collect()} == {0, 1, 2}


def test_both_means_both_lists(spark):
    v = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "node_id long, score double, rank int")
    b = spark.createDataFrame([(2, 3.0, 1), (3, 1.0, 2)], "node_id long, score double, rank int")
    got = {r.node_id: r for r in R.fuse(v, b).collect()}
    assert {k: r.source for k, r in got.items()} == {1: "vector", 2: "both", 3: "bm25"}
    assert got[1].final_score == 0.5 and abs(got[2].final_score - (0.5 * 61 / 62 + 0.3)) < 1e-12
    assert all(0 <= r.final_score <= 1 for r in got.values())


def test_first_file_keeps_all_its_chunks(spark):
    cols = "node_id long, course_name string, section string, teacher string, academic_year string, semester string, source_file string, score double"
    df = spark.createDataFrame([(1, "c", "s", "t", "y", "1", "f1", 0.9), (2, "c", "s", "t", "y", "1", "f1", 0.1), (3, "c", "s", "t", "y", "1", "f2", 0.8), (4, None, None, None, None, None, "f9", 0.2)], cols)
    assert {r.node_id for r in R.first_file(df).collect()} == {1, 2, 4}


def test_plan_filters():
    plan = route.plan_filters
    assert plan({"grade": ["一"]}, {"course_name_keyword": ["微積分"]}).wanted == {"course_name_keyword": ["微積分"]}
    assert plan({"semester": ["1"]}, {"semester": None}, term=("114", "2")).wanted == {"academic_year": ["114"]}
    assert plan({"dept_short": ["資工系"]}, {"dept_short": ["電機系"]}).wanted == {"dept_short": ["資工系"]}
    assert plan({}, term=("114", "2")).wanted == {"academic_year": ["114"], "semester": ["2"]}
    assert plan({}, term=("114", "2"), career=True).wanted == {}
    assert plan({"dept_short": ["a", "b"], "grade": ["一"]}).wanted == {}
    r = route.Route("general")
    assert route.dispatch(r) == "chitchat" and not route.precise(r)
    assert route.dispatch(route.Route("calendar_action")) == "calendar"
    assert route.precise(route.Route(filters=M.Filters({"teacher": ["x"]})))


def test_names_are_consumed_longest_first(spark):
    df = spark.createDataFrame([("資訊工程和工管系的碩士班",), ("通識課",), ("體育課在哪",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(route.departments(F.col("q"))).collect()]
    assert got[:4] == [["資工碩", "工管碩"], ["通識中心"], ["日大學體育"], []]


#: Questions and what rules read in them: year, term, weekday, year of study, periods, required or elective, type.
QUESTIONS = [
    ("114學年度第1學期資工系大一星期三有什麼必修課", "114", "1", "星期三", "一", None, "必修", "course_info"),
    ("電機系大二下禮拜五第二到四節在E321的選修", None, "2", "星期五", "二", "2-4", "選修", "course_info"),
    ("資料結構是必修嗎", None, None, None, None, None, None, "course_info"),
    ("我的畢業學分還差多少", None, None, None, None, None, None, "personal_transcript"),
    ("我禮拜二有什麼課", None, None, "星期二", None, None, None, "personal_schedule"),
    ("推薦幾門有趣的通識自然課程", None, None, None, None, None, "選修", "general"),
    ("哪個實驗室收學生", None, None, None, None, None, None, "professor_info"),
    ("把期中考加到行事曆", None, None, None, None, None, None, "calendar_action"),
    ("什麼時候開學", None, None, None, None, None, None, "academic_calendar"),
    ("請假規定", None, None, None, None, None, None, "policy_rules"),
    ("113下土木系三年級甲班的課", "113", "2", None, "三", None, None, "general"),
    ("你們學校好玩嗎", None, None, None, None, None, None, "general"),
]


def test_rules_read_questions(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(QUESTIONS)], "i int, q string")
    q = F.col("q")
    read = [route.academic_year(q), route.semester(q), route.weekday(q), route.grade(q), route.period_range(q), route.required_or_elective(q), route.question_type(q)]
    got = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(read)]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [x[1:] for x in QUESTIONS]


def test_batches_of_texts_become_python_objects_in_slices():
    import pyarrow as pa

    sizes, texts = [], [f"t{n}" for n in range(2 * T.SLICE + 3)] + [None]

    class Column:
        def __init__(self, held):
            self.held = held

        def __len__(self):
            return len(self.held)

        def slice(self, at, n):
            return Column(self.held[at : at + n])

        def to_pylist(self):
            sizes.append(len(self.held))
            return self.held

    assert T._in_slices(lambda x: x, pa.string(), Column(texts)).to_pylist() == texts and max(sizes) == T.SLICE
    assert len(T._in_slices(lambda x: x, pa.string(), Column([]))) == 0
