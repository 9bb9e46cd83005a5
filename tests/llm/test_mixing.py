from __future__ import annotations

import math

from llm.made import prose

from funnelwright.llm import mixing


def test_exponent_meets_entropy_and_limit(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    totals = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    p = [x / 1110 for x in tokens.values()]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = mixing.exponent(totals, target=0.7, repeats=1e9)
    assert abs(entropy(a) - 0.7) < 1e-3
    assert mixing.exponent(totals, target=0.0, repeats=1e9) == 1.0
    limited = mixing.exponent(totals, target=2.0, repeats=3.0)
    w = [x**limited for x in p]
    assert abs(max(x / sum(w) / y for x, y in zip(w, p)) - 3.0) < 0.01
    assert mixing.exponent(totals.limit(0)) == 1.0


def test_schedule_meets_budgets(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, prose(i, 20 + i % 30), "en", "big") for i in range(300)] + [(1000 + i, prose(i, 25), "en", "small") for i in range(20)]
    rows += [(2000, "only this", "en", None), (2001, None, "en", "none"), (2002, "", "en", "none"), (None, "no id", "en", "big"),
             (5, prose(5, 25), "en", "big"), (2003, prose(7, 3000), "en", "long")]
    docs = documents(rows)
    plan = mixing.schedule(docs).collect()
    weight = {r.source: r.weight for r in plan}
    assert set(weight) == {"big", "small", "", "long"} and abs(sum(weight.values()) - 1) < 1e-6
    budget = sum(len((t or "").split()) for _, t, *_ in rows)
    for source, w in weight.items():
        mine = [r for r in plan if r.source == source]
        used, longest = sum(r.n_tokens for r in mine), max(r.n_tokens for r in mine)
        assert round(w * budget) <= used < round(w * budget) + longest
        epochs = max(r.epoch for r in mine)
        for e in range(epochs):
            # Whole epochs are permutations of all documents of the source.
            assert sum(r.epoch == e for r in mine) == sum((s or "") == source for _, _, _, s in rows)
    first, second = ([(r.block_rank, r.doc_rank, r.doc_id) for r in sorted(plan, key=lambda r: (r.block_rank, r.doc_rank)) if (r.source, r.epoch) == ("small", e)] for e in (0, 1))
    assert first != second[: len(first)]
    mix = mixing.mixed(docs, mixing.schedule(docs))
    assert mix.count() == len(plan) and "text" in mix.columns and mix.columns.count("weight") == 1


def test_empty(documents):
    assert mixing.schedule(documents([])).count() == 0
    assert mixing.schedule(documents([(1, None)])).count() == 0
