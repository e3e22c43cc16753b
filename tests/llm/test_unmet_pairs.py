"""Crowds whose texts are not all connected: every similar pair is given, dissimilar ones do not become rows."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import simhash


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("length", [150, 262])
def test_a_crowd_gives_similar_pairs_only(spark, length):
    rng = random.Random(length)
    base = [f"w{k}" for k in range(length)]
    texts = [edited(rng, base, length // 40 + k % 3) for k in range(60)] + [edited(rng, base[: len(base) - 8], 1) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = simhash.sketches(docs).select("node", "size", "prints", F.struct(F.lit(False).alias("null_id"), "doc_id", "key").alias("first"))
    crowds = rows.select(F.lit(1).cast("long").alias("crowd"), F.col("prints")[0].alias("print")).distinct()
    doc_of = {r.node: r.first.doc_id for r in rows.collect()}
    found = simhash.unmet_pairs(docs, rows, crowds, spark.createDataFrame([], "node long, root long"))
    pairs = {tuple(sorted((doc_of[r.u], doc_of[r.v]))) for r in found.collect()}
    sets = list(map(shingles, texts))
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    every = {(i, j): share(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    similar = {p for p, s in every.items() if s >= simhash.SIMILARITY}
    assert similar and similar <= pairs
    assert all(every[p] > 0.7 for p in pairs) and len(pairs) < len(every) // 2
