from __future__ import annotations

import math
import random

from funnelwright.llm import topk


def brute(rows, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in usable:
        if q % 10:
            continue
        found = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in usable if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = random.Random(4)
    rows = [(i, [draw.choice([0.0, 0.5, -1.0, draw.random()]) for _ in range(6)]) for i in range(120)]
    rows += [(130, [1.0] * 6), (131, [1.0] * 6), (132, [0.0] * 6), (140, []), (141, [2.0]), (150, None), (None, [1.0] * 6),
             (160, [1.0, None]), (161, [float("nan")] * 6), (170, [float("inf")] * 6)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, part int, ids string")
    vectors = topk.scaled(table)
    got = sorted(tuple(r) for r in topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, 7).collect())
    assert got == brute(rows, 7)


def test_few_rows_and_none(spark):
    one = topk.scaled(spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(one.where("vec_id = 0"), one).collect()] == [(0, 1, 5, 1024 * 2048)]
    assert topk.top_k(one.limit(0), one).count() == 0
    assert topk.top_k(one, one.limit(0)).count() == 0


def test_huge_weights_are_clipped(spark):
    vectors = topk.scaled(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.score for r in topk.top_k(vectors.where("vec_id = 0"), vectors).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63)}
