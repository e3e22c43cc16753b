import glob

import pyarrow as pa
import pytest

from marlstone.llm import common, decontaminate, lines, pieces, simhash, toxicity

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.getAll.get(BATCH)
    spark.conf.unset(BATCH)
    yield spark
    spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


def test_tables_outlive_their_source_and_can_be_dropped(spark):
    df = common.materialize(spark.range(10).withColumnRenamed("id", "x"), "numbers")
    assert df.count() == 10 and df.columns == ["x"]
    assert glob.glob(f"{common.run_folder(spark)}/numbers-*/*.parquet")
    common.drop_tables(spark)
    assert not glob.glob(common.run_folder(spark))


@pytest.mark.parametrize("most,marked", [(10, True), (9, False)])
def test_only_small_tables_are_broadcast(spark, monkeypatch, most, marked):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    plan = common.narrow_side(spark.range(10))._jdf.queryExecution().logical().toString()
    assert ("broadcast" in plan) == marked


def test_words_and_windows():
    words = common.PackedWords([b"", b" a  b\x0b c", b"\xc2\x85 d", b"e"])
    assert words.count.tolist() == [0, 3, 2, 1] and words.first.tolist() == [0, 0, 3, 5]
    assert words.windows(2).tolist() == [0, 1, 3]
    h = words.hashes()
    assert len(set(h.tolist())) == 6 and (common.PackedWords([b"x a"]).hashes()[1] == h[0])
    assert list(common.text_slices(common.pa.array(["ab", None, "c" * 9, "d"]), 4)) == [(0, [b"ab", b""]), (2, [b"c" * 9]), (3, [b"d"])]


STEPS = {
    "toxicity": lambda docs: toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")),
    "lines": lines.dropped_lines,
    "sketches": lambda docs: simhash.sketches(docs.selectExpr("doc_id", "xxhash64(text) AS key", "text")),
    "sets": lambda docs: simhash.sets(docs.withColumnRenamed("doc_id", "node")),
    "parities": lambda docs: simhash.parities(docs.withColumnRenamed("doc_id", "node")),
    "leaks": lambda docs: decontaminate.leaks(docs, docs.sparkSession.createDataFrame([(1, "what is the name of the longest river of all")], "item_id long, text string")),
    "encode": pieces.encode,
    "count": pieces.count,
}


@pytest.mark.parametrize("step", STEPS)
def test_texts_go_to_python_in_batches_of_bounded_size(unbounded, step):
    docs = unbounded.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('x', 400000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    STEPS[step](docs.limit(2))
    found = [x.n for x in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 40 * 400_000 and max(found) <= common.BATCH_BYTES + 500_000


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(BATCH, "8m")
    pieces.encode(unbounded.range(1).selectExpr("id AS doc_id", "'a' AS text"))
    assert unbounded.conf.get(BATCH) == "8m"
