"""An index kept up by differences scores like one that is built anew; writers exclude each other."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from marlstone.plans import engine, storage
from marlstone.sources import sinks

WORDS = ["alpha", "beta", "gamma", "delta", "資料庫", "課程", "eps"]


def frames(spark, state: dict[str, list[tuple[int, str | None]]]):
    rows = [(i, t, f) for f, chunks in state.items() for i, t in chunks]
    chunks = spark.createDataFrame(rows, "node_id long, text string, source_file string")
    return chunks, spark.createDataFrame([(i, [float(i)]) for i, _, _ in rows], "node_id long, embedding array<double>")


def scores(spark, index) -> dict:
    terms = engine.query_terms(spark, ["alpha 資料庫", "beta beta gamma", "delta eps nothing"])
    return {(r.query_id, r.node_id): round(r.score, 7) for r in engine.keyword_scores(index, terms).collect()}


def same_index(spark, folder, chunks, vectors):
    stored, memory = engine.load(spark, folder), engine.in_memory(chunks, vectors)
    assert scores(spark, stored) == scores(spark, memory)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    for name, columns in (("chunks", ("node_id", "text", "source_file")), ("vectors", ("node_id", "embedding"))):
        assert pick(getattr(stored, name), *columns) == pick(getattr(memory, name), *columns)
    assert pick(stored.keyword.terms, "term", "df", F.round("idf", 7)) == pick(memory.keyword.terms, "term", "df", F.round("idf", 7))


def test_any_mix_of_changes_scores_like_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(storage, "TERM_FOLDERS", 3)
    folder, rng, last = str(tmp_path / "index"), random.Random(5), 100

    def text():
        return rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))])

    state = {f"f{k}": [(k * 10 + j, text()) for j in range(3)] for k in range(6)}
    assert engine.refresh(*frames(spark, state), folder) == {"new": 6}
    same_index(spark, folder, *frames(spark, state))
    segments = []
    for step in range(3):
        if step:
            gone, changed = rng.sample(sorted(state), 2)
            del state[gone]
            state[changed] = [(i, text()) for i, _ in state[changed][: rng.randint(0, 3)]] + [(last, "alpha")]
            state[f"n{step}"] = [(last + 1, text()), (last + 2, "beta 資料庫")]
            last += 3
        counts = engine.refresh(*frames(spark, state), folder)
        assert counts == ({"new": 1, "modified": 1, "deleted": 1, "unchanged": 4} if step else {"unchanged": 6})
        same_index(spark, folder, *frames(spark, state))
        segments.append(spark.read.parquet(f"{sinks.current_set(spark, folder)}/segments").count())
    assert segments[0] == 1 and 1 < max(segments) <= 3 and segments.count(1) > 1  # it grew, and was compacted


def test_only_changed_files_are_tokenised(spark, tmp_path):
    folder = str(tmp_path / "index")
    chunks, vectors = frames(spark, {f"f{k}": [(k, f"alpha beta{k}")] for k in range(5)})
    engine.build(chunks, vectors, folder)
    later = chunks.withColumn("text", F.when(F.col("node_id") == 3, "gamma").otherwise(F.col("text")))
    read = spark.sparkContext.accumulator(0)

    def tokenize(text):
        def counted(batches):
            for b in batches:
                read.add(len(b))
                yield b.str.split(" ")

        from collections.abc import Iterator

        import pandas as pd

        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return counted(batches)

        return run(text)

    assert engine.refresh(later, vectors, folder, tokenize) == {"modified": 1, "unchanged": 4}
    assert read.value == 1
    assert engine.load(spark, folder).keyword.postings.where("node_id = 3").count() == 1


def test_writers_wait_for_each_other(spark, tmp_path):
    folder, inside, most = str(tmp_path / "set"), [], []

    def work(n):
        with sinks.only_writer(spark, folder, poll=0.02):
            inside.append(n)
            most.append(len(inside))
            time.sleep(0.15)
            inside.remove(n)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert most == [1] * 4


def test_two_builds_at_once_leave_one_index(spark, tmp_path):
    folder = str(tmp_path / "index")
    chunks, vectors = frames(spark, {"a": [(1, "alpha"), (2, "beta")]})
    found = []
    threads = [threading.Thread(target=lambda: found.append(engine.refresh(chunks, vectors, folder))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, found)) == ["{'new': 1}", "{'unchanged': 1}"]
    assert spark.read.parquet(f"{folder}/_versions").count() == 1


def test_a_dead_writer_does_not_block_for_ever(spark, tmp_path):
    folder = str(tmp_path / "set")
    fs, lock = sinks._file_system(spark, f"{folder}/_lock")
    fs.create(lock, False).close()
    with pytest.raises(TimeoutError), sinks.only_writer(spark, folder, stale=60, wait=0.2, poll=0.05):
        pass
    fs.setTimes(lock, int((time.time() - 61) * 1000), -1)
    with sinks.only_writer(spark, folder, stale=60, wait=5, poll=0.05):
        assert fs.exists(lock)
    assert not fs.exists(lock)


def test_replaced_documents_are_indexed_anew(spark, tmp_path):
    docs = lambda n: spark.range(n).selectExpr("id AS doc_id", "'alpha' AS text")
    docs(2).write.parquet(f"{tmp_path}/documents.parquet")
    first = engine.document_index(spark, str(tmp_path))
    assert engine.document_index(spark, str(tmp_path)).postings.inputFiles() == first.postings.inputFiles()
    docs(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert engine.document_index(spark, str(tmp_path)).postings.count() == 3
