import random
import zlib

import numpy as np
import pytest
from helpers import DOCS, corpus, frame

from marlstone.llm import common, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def labelled(n=400, seed=2):
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "ion", "ed", "st", "lo", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        words = [word() for _ in range(rng.randint(40, 120))]
        if bad:
            words[rng.randrange(len(words))] = "vilescum"
            words[rng.randrange(len(words))] = "rotgrub"
        if junk:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


def accuracy(rows, truth, held):
    picked = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out == held and r.doc_id in truth]
    return np.mean([a == b for a, b in picked])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labelled"))
    docs, labels = labelled()
    spark.createDataFrame(docs + [(9001, None, None, None, None), (9002, "", None, None, None), (None, "no id", None, None, None)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (9002, None, None), (77777, 1, 0)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("op,column", [(toxicity.op3_toxicity, 2), (quality.op8_quality_classifier, 1)])
def test_held_out_accuracy(spark, folder, op, column):
    rows = op(spark, folder).collect()
    assert len(rows) == 403
    assert all(0 <= r.score <= 1 for r in rows)
    truth = {x[0]: x[column] for x in labelled()[1]}
    assert accuracy(rows, truth, True) > 0.93
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)


def test_toxic_documents_go(spark, folder):
    docs = common.read(spark, folder, "documents").selectExpr("*", "1 AS score", "'x' AS toxic")
    kept = toxicity.drop_toxic(docs, common.read(spark, folder, "labels"))
    assert kept.columns == docs.columns
    bad = {x[0] for x in labelled()[1] if x[2]}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & bad) < 0.1 * len(bad) and {9001, 9002, None} <= ids


def training(rows, column):
    """(text, label) of the labelled rows that are not held out; a doc_id may come twice."""
    truth = {x[0]: x[column] for x in labelled()[1]}
    return [(r[0], r[1], truth[r[0]]) for r in rows if r[0] in truth and zlib.crc32(str(r[0]).encode()) % 5]


def repeated(rows):
    return rows + rows[5:9] + [(9001, None, None, None, None), (9002, "", None, None, None), (9003, "the vilescum " * 30_000, None, None, None)]


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("doubled"))
    docs, labels = labelled()
    frame(spark, repeated(docs), extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_toxicity_against_a_plain_model(spark, doubled, monkeypatch):
    """Log-ratios by dictionary and dense gradient descent give every score."""
    T = toxicity
    rows = repeated(labelled()[0])
    bucket = {}

    def grams(text):
        t = " ".join(["", *(text or "").lower().split(), ""])
        found = {t[i : i + n] for n in T.ORDERS for i in range(len(t) - n + 1)}
        for g in found - bucket.keys():
            (bucket[g],) = common.rolling(np.array([ord(c) for c in g], np.uint64) + np.uint64(len(g)), len(g), common.BASE) >> np.uint64(64 - T.BUCKET_BITS)
        return {int(bucket[g]) for g in found}

    train = [(d, grams(t), y) for d, t, y in training(rows, 2)]
    n = [sum(y == k for *_, y in train) for k in (0, 1)]
    count = {}
    for _, g, y in train:
        for b in g:
            count.setdefault(b, [0, 0])[y] += 1
    ratio = {b: np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2)) for b, c in count.items() if sum(c) >= min(max(min(n) / 30, 1), T.MIN_TEXTS)}
    features = sorted(b for b, r in ratio.items() if abs(r) >= T.MIN_RATIO)
    r = np.array([ratio[b] for b in features])
    dense = lambda g: np.array([b in g for b in features], float) / np.sqrt(max(1, sum(b in g for b in features)))
    x, y = np.array([dense(g) for _, g, _ in train]) * r, np.array([y for *_, y in train])
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, m, v = (np.zeros(len(features) + 1) for _ in range(3))
    for t in range(1, T.ROUNDS + 1):
        slope = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        g = np.append(x.T @ slope + T.PENALTY * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - 0.1 * m / (1 - 0.9**t) / (np.sqrt(v) / np.sqrt(1 - 0.99**t) + 1e-8)
    expected = sorted((d, 1 / (1 + np.exp(-(dense(grams(t)) * r @ w[:-1] + w[-1])))) for d, t, *_ in rows)
    got = sorted((x.doc_id, x.score) for x in T.op3_toxicity(spark, doubled).collect())
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert np.allclose([s for _, s in got], [s for _, s in expected], atol=1e-6)
    few = T.fit(common.read(spark, doubled, "documents"), common.read(spark, doubled, "labels"), sample_per_class=20)
    assert len(few.buckets) == len(features)  # the sample bounds the weights' rows, not the counts


def plain_statistics(text):
    """One text's numbers, without arrays."""
    t = text or ""
    words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    size = [len(w.encode()) for w in words]
    n = max(1, len(words))
    mean = sum(size) / n
    spread = max(0, sum(s * s for s in size) / n - mean**2) ** 0.5
    held = [c for c in t.encode() if chr(c) in "#*$%&|<>!?.,;:" or chr(c).isalnum() or c >= 128]
    shares = [sum(chr(c) in some for c in held) / max(1, len(held)) for some in ("#*$%&|<>", "!?", ".,;:", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    return [np.log1p(len(words)), min(mean, 30), min(spread, 30), *shares, same, min(len(set(words)) / n**0.8, 2), np.log1p(len(words) / max(1, len(lines))), (len(lines) - len(set(lines))) / max(1, len(lines))]


def test_quality_against_a_plain_model(spark, doubled):
    """Full matrices, one row at a time, and pooling as in the textbook give every score."""
    Q = quality
    rows = repeated(labelled()[0])
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {Q.FOLDS}) AS f").collect()}
    train = training(rows, 1)
    x, y = np.array([plain_statistics(t) for _, t, _ in train]), np.array([y for *_, y in train])
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(Q.SEED)
    turn, phase = rng.normal(size=(12, Q.FEATURES)) / Q.WIDTH, rng.uniform(0, 2 * np.pi, Q.FEATURES)
    lift = lambda s: np.hstack([np.cos(np.clip((s - center) / spread, -6, 6) @ turn + phase) * np.sqrt(2 / Q.FEATURES), np.ones((len(s), 1))])
    f, weight = lift(x), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    eye = np.append(np.full(Q.FEATURES, Q.RIDGE), 1e-9)

    def ridge(at):
        return np.linalg.solve(f[at].T @ np.diag(weight[at]) @ f[at] + np.diag(eye * at.sum()), f[at].T @ (weight[at] * y[at]))

    own = np.array([fold[d] for d, *_ in train])
    bins = lambda raw: np.clip((raw + 1) / 3 * Q.BINS, 0, Q.BINS - 1).astype(int)
    held = np.array([bins(f[i : i + 1] @ ridge(own != own[i]))[0] for i in range(len(y))])
    level = []  # of the bins that have rows
    for b in sorted(set(held)):
        level.append([y[held == b].mean(), (held == b).sum(), [b]])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            hit, n, own_bins = level.pop()
            level[-1] = [(level[-1][0] * level[-1][1] + hit * n) / (level[-1][1] + n), level[-1][1] + n, level[-1][2] + own_bins]
    value = {b: h for h, _, bs in level for b in bs}
    at = bins(lift(np.array([plain_statistics(t) for _, t, *_ in rows])) @ ridge(np.ones(len(y), bool)))
    known = sorted(value)
    step = [value[max((b for b in known if b <= k), default=known[0])] for k in at]
    expected = sorted((r[0], np.clip(s * (1 - 1e-6) + 1e-6 * k / Q.BINS, 0, 1)) for r, s, k in zip(rows, step, at))
    got = sorted((r.doc_id, r.score) for r in Q.op8_quality_classifier(spark, doubled).collect())
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert np.mean(np.isclose([s for _, s in got], [s for _, s in expected], atol=1e-6)) > 0.99  # a raw score at a bin's edge may round either way


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)]])
def test_too_few_labels(spark, tmp_path, labels):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for op in (toxicity.op3_toxicity, quality.op8_quality_classifier):
        rows = op(spark, str(tmp_path)).collect()
        assert len(rows) == len(corpus()) and len({r.score for r in rows}) == 1


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op3_toxicity(spark, str(tmp_path)).count() == 0
    assert quality.op8_quality_classifier(spark, str(tmp_path)).count() == 0


def test_isotonic():
    total, hits = np.array([0, 4, 4, 0, 2, 2]), np.array([0, 3, 1, 0, 1, 2])
    out = quality.isotonic(total, hits)
    assert (np.diff(out) >= 0).all() and np.allclose(out[1:3], 0.5) and out[5] == 1


def test_ngrams_are_distinct_and_case_folded():
    seen = np.zeros(toxicity.BUCKETS, np.int64)
    a, b = toxicity.ngram_buckets("Foo  BAR foo", seen), toxicity.ngram_buckets("foo bar\nFOO", seen)
    assert len(set(a)) == len(a) and set(a) == set(b)
    assert len(toxicity.ngram_buckets(None, seen)) == 0
