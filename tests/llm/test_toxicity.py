from __future__ import annotations

import math
import random

import numpy as np
import pytest

from funnelwright.llm import toxicity
from tests.llm.made import prose

RUDE = "vorkel nastrig zumblat".split()


def brute_round(rows, labels, z, n):
    """The online update as written in the paper, a coordinate at a time."""
    z, n, last = list(z), list(n), len(z) - 1
    for held, label in zip(rows, labels):
        at = [*held, last]
        w = {}
        for i in at:
            limit = 0.0 if i == last else toxicity.L1
            w[i] = 0.0 if abs(z[i]) <= limit else -(z[i] - math.copysign(limit, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + math.exp(-max(min(sum(w.values()), 35), -35))) - label
        for i in at:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return z, n


def test_update_is_the_plain_one():
    draw = random.Random(4)
    rows = [np.array(sorted(draw.sample(range(40), 8))) for _ in range(200)]
    labels = [int(3 in r or 5 in r) for r in rows]
    z, n = np.zeros(41), np.zeros(41)
    wanted = brute_round(rows, labels, z, n)
    toxicity.run_shard(rows, labels, z, n)
    assert np.allclose(z, wanted[0]) and np.allclose(n, wanted[1])


def test_features():
    hasher = toxicity.Hasher()
    own = lambda text: set(hasher.places(text).tolist())
    # Four words of up to four letters: no stems, 3 pairs, 2 with one word between, 1 with two.
    assert len(own("one two Six ten")) == 4 + 3 + 2 + 1
    assert own("one") == own("ONE!") and not own(" .,; ") and not own(None)
    assert own("two one") - own("one two") and len(own("vorkels") & own("vorkelig")) == 3
    assert len(own("one two")) == 3 and len(own("word word word")) == 1 + 2


def table(spark, documents, n=240):
    draw, rows, marks = random.Random(1), [], []
    for i in range(n):
        words = prose(i, 30 + i % 50).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(draw.randint(0, len(words)), draw.choice(RUDE) + draw.choice(["", "", "en", "t"]))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    return documents(rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_rows(spark, documents):
    docs, labels = table(spark, documents)
    model = toxicity.fit(toxicity.labelled(docs, labels, "doc_id % 3 <> 1"))
    assert 0 < len(model.places) < 500
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i % 4 == 0, s >= toxicity.TOXIC) for i, s in found.items() if i % 3 == 1]
    assert all(0 <= s <= 1 for s in found.values())
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and not any(b and not a for a, b in held)


def test_the_same_again_and_by_shards(spark, documents, monkeypatch):
    docs, labels = table(spark, documents)
    first = toxicity.fit(toxicity.labelled(docs, labels, "true"))
    again = toxicity.fit(toxicity.labelled(docs.repartition(7), labels, "true"))
    assert np.array_equal(first.places, again.places) and np.allclose(first.weights, again.weights)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 120)
    shared = toxicity.fit(toxicity.labelled(docs, labels, "true"))
    scores = [r.score for r in toxicity.score(docs.where("doc_id % 4 = 0"), shared).collect()]
    assert np.mean(np.array(scores) > 0.7) > 0.9
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 40)
    assert len(toxicity.fit(toxicity.labelled(docs, labels, "true")).places) <= 40


def test_odd_rows(spark, documents):
    docs, labels = table(spark, documents, 60)
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (2, 1), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, odd, "true").collect()
    assert [(r.id, r.label) for r in rows] == [(2, 1)]
    model = toxicity.fit(toxicity.labelled(docs, labels, "true"))
    asked = documents([(None, "a"), (1, None), (1, ""), (2, "!!"), (3, "vorkel " * 20000), (3, "vorkel " * 20000)])
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(asked, model).collect()), key=repr)
    base = toxicity.probability(model.bias)
    assert [s for d, s in got if d in (1, 2)] == [base] * 3 and len(got) == 6
    assert got[3] == got[4] if got[3][0] == 3 else True
    assert toxicity.score(documents([]), model).count() == 0
    none = toxicity.fit(toxicity.labelled(documents([]), labels, "true"))
    assert [r.score for r in toxicity.score(asked, none).collect()] == [0.5] * 6


@pytest.mark.parametrize("rows", [10, 60])
def test_sample_is_bounded(spark, documents, rows):
    docs, labels = table(spark, documents)
    assert toxicity.labelled(docs, labels, "true", rows).count() <= 2 * rows
