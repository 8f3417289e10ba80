"""Hard negatives against a loop over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.llm import negatives, queries
from tests.compare import difference

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def brute(rows, n_positives=5, k=5):
    good = [(i, [math.floor(256 * x) for x in v], label, n) for n, (i, v, label, *_) in enumerate(rows) if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, x, label, n in good:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j, m, other) for j, y, other, m in good if m != n)
        for p, j, _, _ in [s for s in scored if s[3] == label][:n_positives]:
            within = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(within)]
    return sorted(out)


def made(n, seed, repeats=True):
    rng = random.Random(seed)
    base = [[round(rng.gauss(0, 0.2), 3) for _ in range(8)] for _ in range(n // 3)]
    rows = [(i, [float(np.float32(x + rng.choice([0, 0, 0.01]))) for x in rng.choice(base)], rng.randrange(3), 1, 0.5) for i in range(n)]
    odd = [(n, None, 1, 1, 0.5), (n + 1, [0.1] * 8, None, 1, 0.5), (n + 2, [0.1, None] + [0.2] * 6, 1, 1, 0.5), (n + 3, [float("nan")] * 8, 1, 1, 0.5), (n + 4, [float("-inf")] * 8, 1, 1, 0.5), (None, [0.1] * 8, 1, 1, 0.5)]
    odd += [(n + 20 - n % 10, [0.5, 0.5], 1, 1, 0.5), (n + 8, [], 2, 1, 0.5), (n + 9, [1.0] * 20, 1, 1, 0.5)]
    return rows + odd + (rows[:15] if repeats else [])


def found(spark, rows, **given):
    df = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, **given)
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_matches_sql(spark, sf):
    assert difference(queries.op13_hard_negatives(spark, sf), queries.SQL["op13_hard_negatives"], sf) == ""


@pytest.mark.parametrize("given", [{}, {"anchors_per_group": 7, "rows_per_group": 20}, {"n_positives": 2, "k": 1, "rows_per_group": 3}])
def test_matches_a_loop(spark, given):
    rows = made(150, 4, repeats=False)
    assert found(spark, rows, **given) == brute(rows, given.get("n_positives", 5), given.get("k", 5))


def test_repeated_rows_are_rows(spark):
    rows = made(60, 9)
    assert found(spark, rows, rows_per_group=10) == brute(rows)


def test_many_batches_of_a_cell(spark):
    best = negatives.Best(3, most=50)
    rng = np.random.default_rng(1)
    all_rows = [(int(a), int(s), int(x), n, n) for n, (a, s, x) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 2, 900), rng.integers(0, 40, 900), strict=True))]
    for a, s, x, i, r in all_rows:
        best.add(a, s, np.array([x]), np.array([i]), np.array([r]))
    want = [row for a in range(4) for s in range(2) for row in sorted((r for r in all_rows if r[:2] == (a, s)), key=lambda r: (-r[2], r[3]))[:3]]
    assert [tuple(map(int, r)) for r in zip(*best.cut(), strict=True)] == want


def test_exact_for_large_components():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**30, 0.0]])
    assert negatives.scores(a, b).tolist() == [[2**60 + 1, 2**63 - 1]]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 1, 1, 0.5)]) == []
