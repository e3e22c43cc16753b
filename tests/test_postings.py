"""Postings are counted row by row and written by tasks whose number follows the texts."""

from pyspark.sql import functions as F

from marlstone.operators import retrieve as R
from marlstone.plans import storage


def test_counted_rows_are_the_grouped_tokens(spark):
    rows = [(1, "a b a"), (1, "b a a"), (2, None), (3, ""), (4, "資料庫 a"), *[(k, f"a b{k % 7} b{k % 7}") for k in range(5, 2200)]]
    words = R.tokenised(spark.createDataFrame(rows, "node_id long, text string"))
    merged = R.counted(words).groupBy("term", "node_id", "dl").agg(F.sum("tf").alias("tf"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, R.postings(words).select("term", "node_id", "dl", "tf").collect()))


def test_a_task_sorts_a_bounded_part_of_the_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PART_BYTES", 4_000)
    chunks = spark.createDataFrame([(k, " ".join(f"w{k * j % 50}" for j in range(20))) for k in range(2_000)], "node_id long, text string")
    at = str(tmp_path / "postings")
    storage._write_postings(chunks, at, R.T.tokens)
    files = spark.read.parquet(at).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 2_000  # all 33,000 went to five tasks
    rows = spark.read.parquet(at).select("term", "node_id", "dl", "tf")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, R.postings(R.tokenised(chunks)).select("term", "node_id", "dl", "tf").collect()))


def test_rows_of_one_node_are_one_posting(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b a"), (1, "b a a"), (2, "a")], "node_id long, text string")
    storage._write_postings(chunks, str(tmp_path / "p"), R.T.tokens)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("term", "node_id", "dl", "tf").collect())) == [("a", 1, 3, 4), ("a", 2, 1, 1), ("b", 1, 3, 2)]


def test_a_task_sends_a_bounded_part_of_the_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PART_BYTES", 4_000)
    monkeypatch.setattr(storage, "TEXT_BYTES", 16_000, raising=False)
    chunks = spark.createDataFrame([(k, " ".join(f"w{k * j % 50}" for j in range(20))) for k in range(4_000)], "node_id long, text string").coalesce(1)
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("postings", "postings")
    storage._write_postings(chunks, str(tmp_path / "p"), R.T.tokens)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup("postings") for s in tracker.getJobInfo(job).stageIds}
    tasks = [t for s in stages if store.lastStageAttempt(s).numTasks() for at in [store.lastStageAttempt(s).attemptId()] for t in _each(store.taskList(s, at, 1_000))]
    written = [t.taskMetrics().get().shuffleWriteMetrics().recordsWritten() for t in tasks if t.taskMetrics().isDefined()]
    assert 0 < max(written) <= 4_000 and spark.read.parquet(str(tmp_path / "p")).count() > 60_000  # all of which one task sent


def _each(rows):
    return [rows.apply(k) for k in range(rows.size())]


def test_blocks_hold_the_counted_rows(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k * j % 11}" for j in range(k % 30)) if k % 7 else None) for k in range(3_000)]
    words = R.tokenised(spark.createDataFrame(rows, "node_id long, text string").coalesce(2))
    expected = sorted(map(tuple, R.counted(words).collect()))
    blocks = R.blocks(words)
    assert sorted(map(tuple, R.out_of_blocks(blocks).collect())) == expected
    assert sorted(map(tuple, R.out_of_blocks(R.in_blocks(R.counted(words))).collect())) == expected
    assert blocks.count() * 20 < len(expected) and blocks.agg(F.max(F.size("nodes"))).first()[0] == R.BLOCK
    monkeypatch.setattr(R, "COUNTED", 50)
    assert sorted(map(tuple, R.out_of_blocks(R.blocks(words)).collect())) == expected
