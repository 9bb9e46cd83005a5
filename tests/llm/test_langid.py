from __future__ import annotations

from collections import Counter

import numpy as np

from funnelwright.llm import langid

EN = "the cat and the dog went over the hill to see that thing which was there and they thought of it "
DE = "der hund und die katze gingen über den berg und schauten nach dem ding das dort nicht gewesen ist "


def brute_profile(texts, length):
    seen = Counter()
    for text in texts:
        framed = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        seen.update(g for n in (1, 2, 3) for i in range(len(framed) - n + 1) if (g := framed[i : i + n]) != " ")
    code = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) + 0
    return seen, code


def test_grams_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "STRIP", 7)
    text = "Ärger im Öl, 3 Öle: a--b ǅ " * 3
    keys, counts = langid.grams(text)
    seen, _ = brute_profile([text], 300)
    assert sorted(counts.tolist()) == sorted(seen.values())
    monkeypatch.setattr(langid, "STRIP", 1 << 20)
    whole = langid.grams(text)
    assert np.array_equal(whole[0], keys) and np.array_equal(whole[1], counts)


def test_distance():
    known, places = np.array([5, 7, 9]), np.array([[0, 3], [1, 0], [3, 3]])
    # 7 is first here and second there; 5 second and first; 9 is missing in both (place 3 = length).
    assert langid.distances(np.array([7, 5, 9]), known, places, 3).tolist() == [1 + 1 + 3, 0 + 3 + 3]


def test_predictions(documents):
    docs = documents([(i, EN * (i + 1), "en") for i in range(4)] + [(10 + i, DE * (i + 1), "de") for i in range(4)] + [(20, EN, None), (21, None, "xx")])
    profile = langid.profiles(docs)
    asked = documents([(1, "and the dog thought of the hill"), (2, "und der hund ist nicht dort"), (3, None), (4, ""), (5, "12 34 !!"),
                       (None, EN), (1, "and the dog thought of the hill"), (6, EN * 3000), (7, "ж")])
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict(asked, profile).collect()), key=repr)
    assert [(d, p) for d, p, _ in got] == sorted(
        [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "en"), (7, "de")], key=repr
    )
    assert all(0 <= s <= 1 for _, _, s in got)
    assert langid.predict(documents([]), profile).count() == 0
    assert [r.lang_pred for r in langid.predict(asked, langid.profiles(documents([]))).collect()] == ["und"] * 9
