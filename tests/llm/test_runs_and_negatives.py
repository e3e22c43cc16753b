import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import corpus, frame, same, sha
from pyspark.sql import functions as F

from marlstone.llm import exact, negatives, periodic


def plain_runs(w, min_length=6, min_exponent=4) -> list[tuple]:
    """Every period, every stretch; a stretch counts under its smallest period."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def planted(doc_id, text) -> list[bytes]:
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g, w = h // 10, (text or "").encode().split()
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
    return w


def run_row(doc_id, text) -> tuple:
    w = planted(doc_id, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng, letters=3, parts=5) -> list[bytes]:
    w = []
    for _ in range(rng.randint(0, parts)):
        p = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 7))]
        w += (p * rng.randint(1, 9))[: rng.randint(0, 50)]
    return w


def test_runs_against_every_period():
    rng = random.Random(2)
    for _ in range(400):
        texts = [random_words(rng, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 5))]
        assert periodic.runs_by_text(texts) == [plain_runs(w) for w in texts]


@pytest.mark.parametrize("n,period", [(50_000, 1), (60_000, 7), (60_000, 2_000)])
def test_long_periodic_text_is_one_run(n, period):
    words = [b"%d" % (i % period) for i in range(n)]
    (runs,) = periodic.runs_by_text([words])
    assert runs == [(0, n, period)]
    assert periodic.collapsed(words, runs) == b" ".join(words[:period])


def test_no_run_reaches_into_the_next_text():
    assert periodic.runs_by_text([[b"a"] * 5, [], [b"a"] * 5, [b"a"] * 6]) == [[], [], [], [(0, 6, 1)]]
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), np.zeros(9, np.int64), np.full(9, 9), min_exponent=2)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus() + [(100 + i, " ".join(str(rng.randrange(40)) for _ in range(rng.randint(1, 90))) + "\n" + b"\x0b ".join(random_words(rng)).decode(), None, None, None) for i in range(120)]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    same(periodic.op11_periodic_runs(spark, str(tmp_path)), [run_row(r[0], r[1]) for r in rows])


def test_runs_keep_other_columns(spark):
    df = frame(spark, extra=True).selectExpr("*", "1 AS runs", "2 AS _Runs", "array(3) AS collapsed")
    out = periodic.find_runs(df)
    assert out.columns == [*df.columns, "__runs", "_collapsed"]
    assert sorted(r.doc_id or 0 for r in out.collect()) == sorted(r.doc_id or 0 for r in df.collect())
    assert periodic.find_runs(df.limit(0)).count() == 0


def plain_negatives(rows, anchors, k=5, m=3) -> list[tuple]:
    """rows: (id, label, vector of integers); every pair."""
    out = []
    asked = {(i, c, tuple(v)) for i, c, v in rows if i % anchors == 0}
    for a, label, v in asked:
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, c) for i, c, u in rows if i != a)
        for p, pid, _ in [x for x in scored if x[2] == label][:k]:
            hard = [(s, i) for s, i, c in scored if c != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard[:m])]
    return out


def test_negatives_against_every_pair(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[rng.randint(-60, 60) for _ in range(6)] for _ in range(4)]
    rows = [(i, rng.choice([c, c, rng.randrange(4)]), [x + rng.randint(-9, 9) for x in centres[c]]) for i in range(420) for c in [rng.randrange(4)]]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(150)] + [rows[0], rows[0], rows[7], (50, 2, [0] * 6), (2000, 3, [5]), (2001, 3, [])]
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK", 5)
    monkeypatch.setattr(negatives, "PART_BYTES", 4000)
    df = spark.createDataFrame(rows, "id long, label long, vector array<long>")
    same(negatives.mine(df, F.col("id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), plain_negatives(rows, 10))


def test_tree_leaves_out_what_cannot_win(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (300, 8)) * 100 for c in (-9, 0, 9)]).astype(np.int64)
    ids = rng.permutation(900)
    tree = negatives.BallTree(ids, np.repeat([0, 1, 2], 300), x)
    scored = []
    monkeypatch.setattr(negatives, "dots", lambda a, b, f=negatives.dots: scored.append(len(a) * len(b)) or f(a, b))
    q = x[[0, 310, 620]]
    low, high = np.full((3, 1), -negatives.LARGEST), np.full((3, 1), negatives.LARGEST)
    score, found = tree.best(ids[[0, 310, 620]], np.array([0, 1, 2]), q, low, high, 5, True)
    assert 0 < sum(scored) < 3 * 900 / 2
    for row, at in enumerate((0, 310, 620)):
        own = [j for j in range(900) if j // 300 == row and j != at]
        assert list(zip(score[row, 0], found[row, 0])) == sorted(((q[row] @ x[j], ids[j]) for j in own), key=lambda y: (-y[0], y[1]))[:5]


def test_scores_are_exact_beyond_floats():
    a = np.array([[2**40, 1], [2**62, 2**62]])
    assert negatives.dots(a, np.array([[2**14, 3]])).tolist() == [[2**54 + 3], [negatives.LARGEST]]


def test_negatives_of_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 0.5]), (1, 0, [1.0, 0.4]), (2, 1, [0.8, 0.2]), (3, 1, None), (4, 1, [nan, 1.0]), (5, None, [1.0, 1.0]), (6, 1, [None, 1.0]), (8, 1, [inf, 0.0]), (None, 1, [1.0, 0.0]), (9, 1, []), (10, 2, [0.5, 0.1]), (100, 4, [3e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.selectExpr("*", "1 AS id", "2 AS vector", "3 AS row", "4 AS part").write.parquet(f"{tmp_path}/embeddings.parquet")
    # 0 becomes label 1 (divisible by 7), so 2 and the empty 9 are its positives; 1 scores too much for a negative
    same(negatives.op12_hard_negatives(spark, str(tmp_path)), [(0, 2, 1, 10, 58752, 35968)])
    df.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert negatives.op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0


def plain_groups(rows, keep=max) -> list[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(low), []).append(d)
    out = []
    for text, ids in groups.items():
        first = keep([d for d in ids if d is not None], default=None)
        for n, d in enumerate(sorted(ids, key=lambda d: (d != first, d is None, d))):
            out.append((d, first, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


EXACT = corpus() + [(500 + i, "A copy of É\n", None, None, None) for i in range(40)] + [(None, "a COPY of É\n", None, None, None), (539, "a copy of É\n", None, None, None), (None, "lone", None, None, None)]


def test_exact_dedup_query(spark, tmp_path):
    frame(spark, EXACT, extra=True).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    same(exact.op13_exact_dedup(spark, str(tmp_path)), plain_groups(EXACT))


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    weak = lambda text: F.pmod(F.xxhash64(text), F.lit(3))
    same(exact.decisions(frame(spark, EXACT), digest=weak), plain_groups(EXACT))
    same(exact.decisions(frame(spark, EXACT), "smallest", weak), plain_groups(EXACT, min))


def test_exact_dedup_keeps_columns_and_one_of_repeats(spark):
    df = frame(spark, EXACT, extra=True).selectExpr("*", "1 AS id", "2 AS _ID", "3 AS sha", "4 AS norm", "5 AS digest", "6 AS row", "7 AS n")
    out = exact.dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted((d or -1, t) for d, t in _kept(EXACT))
    assert exact.dedup(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        exact.decisions(df, "first")


def _kept(rows):
    best = {}
    for d, t, *_ in rows:
        k = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        if k not in best or (best[k][0] is None or d is not None and d > best[k][0]):
            best[k] = (d, t or "")
    return best.values()


@pytest.mark.parametrize("op", ["find_runs", "decisions"])
def test_empty_tables(spark, op):
    df = frame(spark).where("false")
    assert (periodic.find_runs(df) if op == "find_runs" else exact.decisions(df)).count() == 0
