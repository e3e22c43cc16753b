import random

from pyspark.sql import functions as F

from marlstone.operators import records as C
from marlstone.operators import retrieve as R
from marlstone.plans import engine
from marlstone.sources import sinks


def test_rows_are_numbered_over_ranges(spark):
    rng = random.Random(1)
    values = [(rng.randrange(50), i) for i in range(500)]
    got = R.numbered(spark.createDataFrame(values, "a int, b int").repartition(7), "a", "b").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 501)) and [(r.a, r.b) for r in got] == sorted(values)
    assert R.numbered(spark.createDataFrame([], "a int, b int"), "a").count() == 0


def test_own_rules_of_any_length(spark):
    names = ["體育", "體育一", "物理實驗", "物理", "微積分", "積分", "x", None]
    rules = [("資工", "體育"), ("資工", "物理實驗（一）"), ("資工", "x"), ("電機", "微積分")]
    courses = spark.createDataFrame([(d, n, 1) for d in ("資工", "電機", "護理") for n in names], "dept string, name string, credits int")
    got = {(r.dept, r.name): r.own for r in C.own_required(courses, spark.createDataFrame(rules * 2, "dept string, rule_course string")).collect()}
    expected = {(d, n): n is not None and any(d == k and (n in r or r in n) for k, r in rules) for d in ("資工", "電機", "護理") for n in names}
    assert got == expected


def test_tables_of_a_version_go_together(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert sinks.current_set(spark, folder) is None

    def version(n):
        def write(at):
            spark.range(n).write.parquet(f"{at}/a")
            spark.range(n).write.parquet(f"{at}/b")

        return write

    def broken(at):
        spark.range(9).write.parquet(f"{at}/a")
        raise RuntimeError

    sinks.publish_set(spark, folder, version(2))
    sinks.publish_set(spark, folder, version(3))
    try:
        sinks.publish_set(spark, folder, broken)
    except RuntimeError:
        pass
    at = sinks.current_set(spark, folder)
    assert [spark.read.parquet(f"{at}/{t}").count() for t in "ab"] == [3, 3]


def test_an_index_of_few_texts(spark, tmp_path):
    for k, texts in enumerate(([], [None, ""], ["a b", None, "b b 資料庫"])):
        chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node_id long, text string")
        at = str(tmp_path / str(k))
        engine.build_keywords(chunks, at)
        stored, memory = engine.read_keywords(spark, at), R.keyword_index(chunks)
        rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
        assert rows(stored.postings, "term", "node_id", "tf", "dl") == rows(memory.postings, "term", "node_id", "tf", "dl")
        assert rows(stored.terms, "term", "df", F.round("idf", 9)) == rows(memory.terms, "term", "df", F.round("idf", 9)) and stored.avgdl == memory.avgdl


def test_an_index_is_reloaded_when_it_is_published_anew(spark, tmp_path):
    folder = str(tmp_path / "index")
    chunks = spark.createDataFrame([(1, "a b"), (2, "c")], "node_id long, text string")
    vectors = spark.createDataFrame([(1, [0.5])], "node_id long, embedding array<float>")
    assert engine.reloaded(spark, folder, None) is None
    engine.build(chunks, vectors, folder)
    first = engine.reloaded(spark, folder, None)
    assert engine.reloaded(spark, folder, first) is first
    engine.build(chunks.limit(1), vectors, folder)
    second = engine.reloaded(spark, folder, first)
    assert second is not first and (first.chunks.count(), second.chunks.count()) == (2, 1)


def test_texts_within_texts_against_every_pair(spark):
    import random

    from marlstone.operators import records as C

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab資料") for _ in range(rng.randint(0, 7)))
    inner, outer = [(rng.randrange(2), word()) for _ in range(150)], [(rng.randrange(2), word() + word()) for _ in range(150)]
    a, b = (spark.createDataFrame([*rows, (0, None)], f"dept int, {name} string") for rows, name in ((inner, "inner"), (outer, "outer")))
    expected = sorted({(d, i, o) for d, i in inner for e, o in outer if d == e and i and i in o})
    assert sorted(map(tuple, C.contained(a, b, "dept").collect())) == expected


def test_a_common_opening_pairs_nothing(spark):
    from marlstone.operators import records as C

    names = spark.range(400).selectExpr("concat('a common opening ', id + 1000, 'x') AS inner")
    texts = spark.range(400).selectExpr("concat('a common opening ', id + 1000, 'x and more') AS outer")
    met = C.contained(names, texts)
    assert met.count() == 400
    grams = texts.selectExpr("outer", "explode(transform(sequence(1, length(outer) - 2), i -> substring(outer, i, 3))) AS g").distinct()
    often = dict(grams.groupBy("g").count().collect())
    candidates = sum(min(often[n.inner[i : i + 3]] for i in range(len(n.inner) - 2)) for n in names.collect())
    assert candidates <= 400 * 60  # by the opening alone: 400 * 400
