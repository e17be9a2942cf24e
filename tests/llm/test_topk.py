import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weavegrid.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, every=20, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows):
    return sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect())


def test_random_and_tied(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=40).tolist() if i % 3 else [0.5] * 40, 1) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_pruning_keeps_results(spark, monkeypatch):
    monkeypatch.setattr(topk, "DIMENSION_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * (5.0 if i % 40 == 0 else 1) * np.exp(-np.arange(16))).tolist(), 1) for i in range(700)]
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1.0, -2.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 1.0], 1), (5, [1.0, 1.0], 1), (20, [-0.01, 0.3], 1), (20, [3.0, 0.3], 1), (None, [1.0, 1.0], 1), (7, [2.0], 1), (8, [], 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []


def test_large_components(spark):
    rows = [(0, [1e9, -1e9], 1), (1, [1e9, 3.0], 1), (2, [-1e9, 5.0], 1), (3, [0.25, 1e7], 1)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_kernel(k):
    rng = np.random.default_rng(3)
    q, c = rng.integers(-9, 9, (7, 48)).astype(float), rng.integers(-9, 9, (48, 90)).astype(float)
    ids = rng.permutation(90).astype(np.int64)
    for i, d, s in topk.best_of_block(q, ids[:7], c, ids, k):
        want = sorted((-int(q[i] @ c[:, j]), int(ids[j])) for j in range(90) if ids[j] != ids[i])[:k]
        assert [(-x, y) for x, y in want] == list(zip(s.tolist(), d.tolist()))


def test_bounds_save_work_and_change_nothing():
    rng = np.random.default_rng(2)
    n, dims, k = 9000, 64, 20
    c = np.floor(64 * rng.normal(size=(n, dims)) * 0.9 ** np.arange(dims)[rng.permutation(dims)])
    q, ids = c[::60].copy(), np.arange(n)
    work = topk.Work()
    found = {i: (d.tolist(), s.tolist()) for i, d, s in topk.best_of_block(q, ids[::60], np.ascontiguousarray(c.T), ids, k, work)}
    scores = q @ c.T
    for i in range(len(q)):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != 60 * i][:k]
        assert found[i] == (order, scores[i][order].astype(int).tolist())
    assert work.all == q.size * n and work.made < 0.5 * work.all


def test_rows_that_repeat_as_a_whole(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1)] * 50 + [(2, [1.0, 1.0], 1), (20, [2.0, 0.0], 0)], "vec_id long, embedding array<double>, rank int")
    found = topk.top_k(rows, "vec_id % 20 = 0", 30).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found)] == [(i + 1, 1) for i in range(30)]
