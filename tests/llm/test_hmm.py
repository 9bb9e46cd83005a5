from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from llm.made import prose
from pyspark.sql import functions as F

from funnelwright.llm import hmm


def small_model(classes=5, states=3):
    draw = np.random.default_rng(1)
    start, step, emit = draw.random(states + 1), draw.random((states, states + 1)), draw.random((classes, states))
    return hmm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), np.full(states, 1 / states))


def brute_paths(model, text):
    """Probability of each state path of a text, by enumeration."""
    states = len(model.step)
    for path in itertools.product(range(states), repeat=len(text)):
        p = model.start[path[0]] if path else model.start[states]
        for t, (s, c) in enumerate(zip(path, text)):
            p *= model.emit[c, s] * model.step[s, path[t + 1] if t + 1 < len(path) else states]
        yield path, p


def test_forward_is_exact():
    model = small_model()
    texts = [[0, 1, 4, 2], [], [3], [2, 2, 2, 2, 2, 1], [0, 1]]
    got = hmm.log_likelihoods(model, [np.array(t, np.uint16) for t in texts])
    assert got == pytest.approx([math.log(sum(p for _, p in brute_paths(model, t))) for t in texts])


def test_expected_counts_are_exact():
    model, texts = small_model(), [[0, 1, 4, 2], [], [3], [2, 2, 1]]
    starts, steps, emit, log = hmm.expected_counts(model, [(np.array(t, np.int64), True, True) for t in texts])
    want = np.zeros(4), np.zeros((3, 4)), np.zeros((5, 3))
    for text in texts:
        paths = list(brute_paths(model, text))
        total = sum(p for _, p in paths)
        for path, p in paths:
            want[0][path[0] if path else 3] += p / total
            for t, s in enumerate(path):
                want[1][s, path[t + 1] if t + 1 < len(path) else 3] += p / total
                want[2][text[t], s] += p / total
    for mine, exact in zip((starts, steps, emit), want):
        assert mine == pytest.approx(exact)


def test_scores(documents):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(60)] + [(100, None), (101, ""), (None, prose(3, 10)), (5, prose(5, 25)), (102, prose(4, 5000)),
                                                              (103, "x" * 100_000 + " unseen ÄÖ")]
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = hmm.score(documents(rows), learnt, ~learnt).collect()
    import zlib

    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    tokens = {(d, t): [*(t or "").encode().lower().split(), b""] for d, t in rows}
    seen = Counter(w for d, t in rows if d is not None and fold(d) != 2 for w in tokens[d, t])
    total, distinct = sum(seen.values()), len(seen)
    want = sorted(
        ((d, fold(d) == 2, len(w), sum(x in seen for x in w), total, round(sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in w), 6))
         for (d, t) in rows for w in [tokens[d, t]]), key=repr,
    )
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)


def test_states_learn_what_unigrams_cannot(documents):
    # Two kinds of texts with words of their own: a state that stays in its kind predicts them better.
    kinds = ["ka ke ki ko ku kam kem kim".split(), "za ze zi zo zu zam zem zim".split()]
    rows = [(i, " ".join(kinds[i % 2][(i * k * k + 3 * k) % 8] for k in range(40))) for i in range(200)]
    learnt = F.col("doc_id") % 5 != 0
    held = [r for r in hmm.score(documents(rows), learnt, ~learnt).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_nothing_to_learn_from(documents):
    got = hmm.score(documents([(1, "a b"), (2, None)]), F.lit(False), F.lit(True)).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens) for r in got} == {(1, 0, 0), (2, 0, 0)}
    assert hmm.score(documents([]), F.lit(True), F.lit(False)).count() == 0


def test_every_round_uses_every_training_text(documents, monkeypatch):
    seen, whole = [], hmm.baum_welch

    def counted(texts, model, priors):
        seen.append(texts.count())
        return whole(texts, model, priors)

    monkeypatch.setattr(hmm, "baum_welch", counted)
    hmm.score(documents([(i, f"w{i % 7} v{i % 5}") for i in range(4000)]), F.lit(True), F.lit(False))
    assert seen == [4000] * 10


def test_counts_between_scalings_and_of_windows(monkeypatch):
    model, draw = small_model(), np.random.default_rng(4)
    texts = [draw.integers(0, 5, n) for n in (10, 9, 8, 1, 0, 10)]
    flags = [(True, True), (True, False), (False, False), (False, True), (True, True), (False, True)]
    want = np.zeros(4), np.zeros((3, 4)), np.zeros((5, 3))
    log = 0.0
    for text, (first, last) in zip(texts, flags):
        text = text.tolist()
        start = model.start[:3] if first else model.occupancy
        ways = []
        for path in itertools.product(range(3), repeat=len(text)) if text else ():
            p = start[path[0]]
            for t, (s, c) in enumerate(zip(path, text)):
                p *= model.emit[c, s] * (model.step[s, path[t + 1]] if t + 1 < len(path) else 1)
            ways.append((path, p, p * (model.step[path[-1], 3] if last else 1)))
        log += math.log(sum(p for _, p, _ in ways)) if ways else 0.0
        total = sum(p for *_, p in ways)
        want[0][3] += not text
        for path, _, p in ways:
            want[0][path[0]] += first * p / total
            for t, (s, c) in enumerate(zip(path, text)):
                want[2][c, s] += p / total
                if t + 1 < len(path) or last:
                    want[1][s, path[t + 1] if t + 1 < len(path) else 3] += p / total
    windows = [(x.astype(np.uint16), *f) for x, f in zip(texts, flags)]
    for scaled, room in ((1, None), (3, np.full(3 * 3 * 38, 7.0)), (hmm.SCALED, np.full(1000, np.nan))):
        monkeypatch.setattr(hmm, "SCALED", scaled)
        *counts, found = hmm.expected_counts(model, windows, room)
        for mine, exact in zip((*counts, found), (*want, log)):
            assert mine == pytest.approx(exact)


def test_a_long_text_is_trained_in_portions(monkeypatch):
    sizes, whole = [], hmm.expected_counts

    def counted(model, windows, *room):
        sizes.append(sum(len(w[0]) for w in windows))
        return whole(model, windows, *room)

    monkeypatch.setattr(hmm, "expected_counts", counted)
    monkeypatch.setattr(hmm, "TOKENS", 4096)
    text = np.arange(20_000, dtype=np.uint16) % 5
    (out,) = hmm._expect(small_model())(iter([hmm.pa.RecordBatch.from_arrays([hmm.pa.array([text.tobytes()], hmm.pa.binary())], names=["classes"])]))
    assert sum(sizes) == 20_000 and max(sizes) <= 1024 + hmm.WINDOW
    assert sum(out.column(f"s{k}")[r].as_py() for k in range(3) for r in range(5)) == pytest.approx(20_000)
