"""Block-wise nearest vectors against every pair."""

import numpy as np
import pytest

from marlstone.operators import nearest as N


def every_pair(rows, queries, k):
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-12)
    out = []
    for q, v in queries:
        scored = sorted((-(round(float(unit(v) @ unit(x)), 6) + 0.0), i) for i, x in rows)
        out += [(q, i, round(-s, 5) + 0.0, n + 1) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("part_bytes,block", [(16 << 20, 256), (2_000, 3)])
def test_against_every_pair(spark, monkeypatch, part_bytes, block):
    monkeypatch.setattr(N, "PART_BYTES", part_bytes)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-5, 6, 4).astype(float).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(120)] + [(2000, [0.0] * 4)]  # many equal ones
    queries = rows[:7] + [(-1, [2.0, 4.0, 6.0, 8.0]), (-2, [0.0] * 4)]
    df = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.node_id, round(r.score, 5) + 0.0, r.rank) for r in N.nearest(df, asked, 9).collect())
    assert got == every_pair(rows, queries, 9)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (5, [None, 1.0]), (None, [1.0, 0.0])], "node_id long, embedding array<double>")
    rows = df.where("node_id IS NOT NULL")
    asked = spark.createDataFrame([(7, [3.0, 0.0]), (8, [2.0]), (9, None)], "query_id long, embedding array<double>")
    assert [tuple(r) for r in N.nearest(rows, asked, 5).collect()] == [(7, 1, 1.0, 1)]
    assert N.nearest(rows.limit(0), asked, 5).count() == 0
    assert N.nearest(rows, asked.limit(0), 5).count() == 0


def test_first_of_shared_scores():
    scores, ids = np.array([[1.0, 3.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0]]), np.array([4, 5, 6, 9])
    r, c = N.first_of(scores, ids, 2)
    assert list(zip(r.tolist(), ids[c].tolist())) == [(0, 5), (0, 6), (1, 4), (1, 5)]
