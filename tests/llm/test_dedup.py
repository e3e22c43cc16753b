import numpy as np
import pytest
from helpers import components, corpus, drop_lines, drop_windows, fingerprint, frame, same, similar_groups
from pyspark.sql import functions as F

from marlstone.llm import lines, simhash, substrings


def write(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("partitions", ["5", "37"])
def test_lines_against_brute_force(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(lines.op1_line_dedup(spark, write(spark, tmp_path, frame(spark))), drop_lines(corpus()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_frequent_line_spans_ranges(spark, tmp_path):
    rows = [(i, f"a line that nearly every document holds\nown {i}", None, None, None) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(lines.op1_line_dedup(spark, write(spark, tmp_path, frame(spark, rows))), drop_lines(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_keep_other_columns(spark):
    df = frame(spark, extra=True)
    out = lines.dedup(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    assert out.count() == df.count()


def test_windows_against_brute_force(spark, tmp_path):
    same(substrings.op9_substring_dedup(spark, write(spark, tmp_path, frame(spark))), drop_windows(corpus()))


def test_sketch_misses_no_repeat_at_any_width(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(substrings, "MAX_BITS", 16)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substrings, "FLUSH", 50)
    same(substrings.op9_substring_dedup(spark, write(spark, tmp_path, frame(spark))), drop_windows(corpus()))


def test_windows_of_many_chunks_on_few_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 40)  # more than a thousand chunks on five partitions
    monkeypatch.setattr(substrings, "FLUSH", 50)
    monkeypatch.setattr(substrings, "ANSWER_FLUSH", 50)
    rows = corpus() + [(1000 + i, corpus()[16][1], None, None, None) for i in range(40)]
    same(substrings.op9_substring_dedup(spark, write(spark, tmp_path, frame(spark, rows))), drop_windows(rows))


def test_windows_keep_other_columns(spark):
    df = frame(spark, extra=True).selectExpr("*", "2 AS more", "3 AS id", "timestamp'2024-01-01' AS at", "array('a') AS many")
    out = substrings.dedup(df)
    assert out.columns == [*df.columns, "__n_words", "__n_removed"]
    assert sorted((r.doc_id, r.id, r.many) for r in out.collect() if r.doc_id) == sorted((r.doc_id, r.id, r.many) for r in df.collect() if r.doc_id)


@pytest.mark.parametrize("op,own", [(lines.dedup, ("__n_lines", "__n_dropped")), (substrings.dedup, ("__n_words", "__n_removed"))])
def test_columns_named_like_internal_ones(spark, op, own):
    names = ["__id", "__chunk", "__n_words", "__N_removed", "__n_lines", "__n_dropped", "__doc", "__key", "__keep", "chunk", "payload"]
    df = frame(spark).selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    out = op(df)
    assert out.columns == [*df.columns, *[f"_{n}" for n in own]]
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert out.count() == df.count()


def test_packing():
    import numpy as np

    a, b = np.array([5, 2**63], np.uint64), np.array([-1, 7], np.int32)
    x, y = substrings.unpack(substrings.pack(a, b), np.uint64, np.int32)
    assert (x == a).all() and (y == b).all()


def test_simhash_against_brute_force(spark, tmp_path):
    rows = corpus()
    out = simhash.op10_simhash(spark, write(spark, tmp_path, frame(spark))).collect()
    prints = [fingerprint(r[1]) for r in rows]
    roots = components(prints)
    first = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            first[root] = min(first.get(root, r[0]), r[0])
    expected = [(r[0], f"{p:016x}", first.get(root)) for r, p, root in zip(rows, prints, roots)]
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def test_distinct_words_find_edited_copies(spark):
    import random

    rng = random.Random(7)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(4000)]
    texts = [" ".join(rng.sample(words, 400)) for _ in range(60)]
    edited = [t.replace(t.split()[200], "edited") for t in texts]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts + edited)])
    kept = {r.doc_id for r in simhash.keep_one(df, shingle=1, distinct=True).collect()}
    assert kept >= set(range(60)) and len(kept) < 105
    assert simhash.keep_one(df).count() >= len(kept)


def test_pipeline_drops_edited_copies_that_are_similar(spark):
    import random

    import corpus_pipeline

    rng = random.Random(7)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(4000)]
    texts = [" ".join(rng.sample(words, 400)) for _ in range(40)]
    edited = [t.replace(t.split()[200], "edited") for t in texts]
    shuffled = [" ".join(rng.sample(t.split(), 400)) for t in texts]  # the same words, no shingle in common
    rows = [(i, t, None, None, None) for i, t in enumerate(texts + edited + shuffled)] + [(500, None, None, None, None), (501, "", None, None, None), (None, " ", None, None, None)]
    df = frame(spark, rows, extra=True)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    kept = [r.doc_id for r in out.collect()]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(396)}
    assert all(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for a, b in zip(texts, edited))
    assert out.columns == df.columns and len(kept) == len(set(kept))
    assert set(kept) >= {*range(40), *range(80, 120), 500} and not set(kept) & {501, None} and not set(kept) & set(range(40, 80))
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def edits(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("crowd", [1, simhash.ALL_PAIRS, None])
def test_similar_groups_against_brute_force(spark, crowd):
    import random

    rng = random.Random(11)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(3000)]
    hot = rng.sample(words, 150)
    texts = [edits(rng, hot, rng.randint(0, 5)) for _ in range(120)]  # a large group, many pairs of which are not similar
    for _ in range(40):
        base = rng.sample(words, rng.randint(60, 300))
        texts += [" ".join(base), " ".join(base), edits(rng, base, rng.randint(1, 6)), " ".join(reversed(base))]
    texts += [None, "", " ", "one", "one two", "ONE two", texts[0].upper(), " ".join(rng.choices(words, k=90_000))]
    texts.append(texts[-1] + " end")
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], extra=True)
    out = simhash.keep_one_similar(df.selectExpr("*", "1 AS node", "2 AS __key", "3 AS __row_key"), all_pairs=crowd)
    kept, expected = {r.doc_id for r in out.collect()}, set(similar_groups(texts))
    assert out.columns == [*df.columns, "node", "__key", "__row_key"]
    assert kept >= expected and len(kept - expected) <= 0.05 * (len(texts) - len(expected))


def test_meeting_pairs():
    value = np.array([1, 1, 1, 2, 2] + [3] * 20, np.int64)
    prints = np.array([10, 11, 12, 13, 14, *range(20, 40)], np.int64)
    u, v = simhash.meeting_pairs(value, prints)
    got = set(zip(u.tolist(), v.tolist()))
    assert {(10, 11), (10, 12), (11, 12), (13, 14)} == {x for x in got if x[0] < 20} and len(got) == 4 + 19 + 18
    assert {x for p in got for x in p} == set(prints.tolist())
    assert len(simhash.meeting_pairs(value[:0], prints[:0])[0]) == 0
    assert len(simhash.meeting_pairs(value, prints, None, None)[0]) == 3 + 1 + 20 * 19 // 2


def test_many_rows_of_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash.common, "BROADCAST_ROWS", 0)
    rows = [(i, None if i % 2 else " ", None, None, None) for i in range(5000)] + [(5000 + i, f"own words {i} stand here", None, None, None) for i in range(50)]
    found = simhash.near_duplicates(simhash.fingerprints(frame(spark, rows)))
    assert found.where("fingerprint = 0").agg(F.count("*"), F.min("component_id"), F.max("component_id"), F.max("root")).first() == (5000, 0, 0, 0)
    assert found.where("fingerprint <> 0 AND component_id <= doc_id").count() == 50


def test_word_prints_of_long_texts():
    from marlstone.llm import common

    texts = [b"", b"a b c a", b" ".join(b"%d" % i for i in range(200_000))]
    words = common.PackedWords(texts)
    prints = simhash.word_prints(words, 48, 2)
    assert not prints[0].any()
    for row, text in enumerate(texts):
        alone = common.PackedWords([text])
        h = sorted(set(alone.hashes().tolist()))
        for k, salt in enumerate(common.mix(np.arange(1, 3, dtype=simhash._U))):
            vote = common.mix(np.array(h, simhash._U) ^ salt)
            assert prints[row, k] == sum(1 << b for b in range(48) if 2 * int(((vote >> simhash._U(b)) & simhash._U(1)).sum()) > len(h))


def test_ball_links_random_prints(spark):
    import random

    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(rng.randint(0, 5)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(prints))] == components(prints)
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = simhash.components(edges).collect()
    assert {r.node for r in got} == set(range(200)) and {r.root for r in got} == {0}


def test_keep_one(spark):
    df = frame(spark, extra=True)
    rows = corpus()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert len({(r.doc_id, r.text) for r in kept.collect()}) == len(set(components([fingerprint(r[1]) for r in rows])))


@pytest.mark.parametrize("op", [lambda d: lines.dedup(d), lambda d: substrings.dedup(d), lambda d: simhash.near_duplicates(simhash.fingerprints(d)), lambda d: simhash.keep_one(d)])
def test_empty_tables(spark, op):
    assert op(frame(spark, [])).count() == 0


def test_crowds_lose_no_link(spark):
    import random

    rng = random.Random(5)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(900)]
    texts = []
    for _ in range(2):
        hot = rng.sample(words, 60)
        for _ in range(12):  # the same words in another order: one fingerprint, nothing in common
            base = rng.sample(hot, 60)
            texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base[1:], base[1]])]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(rng.sample(texts, len(texts)))], extra=True)
    kept = lambda **crowd: {r.doc_id for r in simhash.keep_one_similar(df, **crowd).collect()}
    expected = kept(all_pairs=None)
    assert kept() == kept(all_pairs=1, most_reps=1) == expected and len(expected) <= 30
