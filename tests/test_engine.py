import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates as D
from marlstone.operators import inject as I
from marlstone.operators import match as M
from marlstone.plans import engine, mapping, route
from marlstone.sources import readers as S


@pytest.fixture(scope="module")
def index_folder(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("engine") / "index")
    assert engine.load(spark, folder) is None
    engine.build(mapping.chunks(spark, sf_dir), mapping.vectors(spark, sf_dir).select("node_id", "embedding"), folder)
    return folder


def test_published_index_scores_like_the_one_in_memory(spark, sf_dir, index_folder):
    stored = engine.load(spark, index_folder)
    terms = engine.query_terms(spark, ["the there", "von der"])
    memory = engine.in_memory(mapping.chunks(spark, sf_dir), mapping.vectors(spark, sf_dir))
    pick = lambda i: {(r.query_id, r.node_id): round(r.score, 9) for r in engine.keyword_scores(i, terms).collect()}
    assert pick(stored) == pick(memory) != {}
    plan = stored.keyword.postings.where("folder = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan


def test_answer(spark, sf_dir, index_folder):
    index = engine.load(spark, index_folder)
    vectors = mapping.query_vectors(spark, sf_dir)
    r = route.Route("course_info", M.Filters({"teacher": ["src1"]}), search_queries=("the there",))
    terms = engine.query_terms(spark, ["the there"])
    rows = engine.evidence(index, r, terms, vectors).collect()
    assert rows and len({x.node_id for x in rows}) == len(rows)
    blocks = engine.context(engine.evidence(index, r, terms, vectors)).orderBy("rank").collect()
    assert [b.rank for b in blocks] == list(range(1, len(rows) + 1))
    assert engine.answer(index, r, [], vectors) == blocks[0].block
    assert engine.answer(index, r, [], vectors, lambda b: f"{len(b)}") == str(len(blocks))
    with pytest.raises(ValueError):
        engine.answer(index, route.Route("calendar_action"), [], vectors)
    with pytest.raises(ValueError):  # general and without filters: small talk
        engine.answer(index, route.Route(), [], vectors)


def test_nothing_found(spark, sf_dir, index_folder):
    index = engine.load(spark, index_folder)
    none = engine.Index(index.chunks.limit(0), index.keyword, index.vectors.limit(0), split=True)
    r = route.Route("course_info", M.Filters({"teacher": ["src1"]}), search_queries=("zzzz",))
    assert engine.answer(none, r, [], mapping.query_vectors(spark, sf_dir)) == engine.NOTHING


def test_strict_injection_needs_a_named_thing(spark, sf_dir):
    c = mapping.chunks(spark, sf_dir)
    assert I.by_metadata(c, M.Filters({"semester": ["1"]})).count() == 0
    assert I.by_metadata(c, M.Filters({"dept_short": ["en"]})).count() == 0
    both = I.by_metadata(c, M.Filters({"dept_short": ["en"], "grade": ["一"]}))
    assert both.count() == c.where("section = 'basic_info' AND dept_short = 'en' AND grade = '一'").count() > 0
    assert I.by_intent(c, "course_info").count() == 0


def test_curriculum_takes_all_of_the_own_department(spark, sf_dir):
    c = mapping.chunks(spark, sf_dir)
    term = "section IN ('basic_info', 'objectives') AND academic_year = '114' AND semester = '2'"
    own = I.curriculum(c, "en", "114", "2").join(c, "node_id").where("dept_short = 'en'")
    assert own.where(term).count() == c.where(term + " AND dept_short = 'en'").count() > 0
    others = I.curriculum(c, None, "114", "2").join(c, "node_id").select("course_name", "dept_short").distinct()
    assert 0 < others.count() <= 15


def test_departments_of_paths(spark):
    df = spark.createDataFrame([("114-1/資訊工程學系/a.txt", "日間部"), ("電機工程/b.txt", "碩士班"), ("x/y.txt", "")], "p string, d string")
    assert [r[0] for r in df.select(S.path_department(F.col("p"), F.col("d"))).collect()] == ["資工系", "電機碩", "未知系"]
    names = spark.createDataFrame([("水利系教授資訊",), ("藝術簡介",), ("藝術中心",)], "n string")
    assert [r[0] for r in names.select(S.folder_department(F.col("n"))).collect()] == ["水利系", "藝術系", "藝術中心"]


def test_announcements(spark):
    table = '<table class="table x"><tr><td>2026-03-01</td><td><a href="/a">First <b>notice</b></a></td><td>Office</td></tr><tr><td>no link</td><td>x</td></tr><tr><td>only</td></tr></table><a href="/z">a long enough link</a>'
    plain = '<a href="/n">English version here</a><a href="http://b/c">a long enough title</a><a href="/d">a long enough title</a><a href="#top">another long title</a><a href="/s">short</a>'
    pages = spark.createDataFrame([(1, table), (2, plain), (3, ""), (4, None)], "page_id long, html string")
    rows = {(r.page_id, r.title, r.url, r.unit, r.date) for r in S.announcements(pages, "http://site").collect()}
    assert rows == {(1, "First notice", "http://site/a", "Office", "2026-03-01"), (2, "a long enough title", "http://b/c", "", "")}


def test_spoken_periods_and_topics(spark):
    df = spark.createDataFrame([("早上有課嗎",), ("星期三下午的課",), ("微積分在哪",), ("我有幾學分",), ("哪天有空",), (None,)], "q string")
    got = df.select(route.with_periods(F.col("q")), route.schedule_topic(F.col("q"), F.array(F.lit("微積分"), F.lit("")))).collect()
    assert got[0][0] == "早上有課嗎 (第1節 第2節 第3節 第4節 上午)" and got[1][0].endswith("第9節)") and got[2][0] == "微積分在哪"
    assert [r[1] for r in got[:5]] == ["full", "day", "course", "credits", "free"]


def test_list_windows_and_removals(spark):
    rows = [("2026-03-01 00:00:00", None, None), ("2026-03-01 00:00:00", None, "2026-03-05 00:00:00"), (None, None, "2026-03-05 00:00:00"), (None, None, None), ("2026-03-01 00:00:00", "2026-03-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "s string, e string, t string").select(*[F.col(c).cast("timestamp").alias(c) for c in "set"])
    low, high = D.list_range(F.col("s"), F.col("e"), F.col("t"), F.lit("2026-01-01").cast("timestamp"))
    got = [(a.strftime("%m-%d"), b.strftime("%m-%d")) for a, b in df.select(low, high).collect()]
    assert got == [("03-01", "03-31"), ("03-01", "03-06"), ("03-05", "03-06"), ("01-01", "01-08"), ("03-01", "03-02")]
    said = spark.createDataFrame([("全部", "x"), ("*", "custom_event"), ("課表", "x"), ("會議", "import_schedule"), ("會議", "x")], "n string, i string")
    assert [r[0] for r in said.select(D.removal_keyword(F.col("n"), F.col("i"))).collect()] == ["*", "*", "[課程]", "[課程]", "會議"]
