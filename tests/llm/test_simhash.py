from __future__ import annotations

import itertools

import numpy as np
from llm.made import prose
from pyspark.sql import functions as F

from funnelwright.llm import simhash


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_hash_is_sparks(spark):
    text = "One two  Three\tfour"
    want = spark.range(1).select(F.xxhash64(F.lit("one two three")), F.xxhash64(F.lit("two three four"))).first()
    assert simhash.shingle_hashes(text, 3).view(np.int64).tolist() == list(want)
    assert simhash.shingle_hashes("One two", 3).view(np.int64).tolist() == [spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0]]
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3)) == simhash.fingerprint(simhash.shingle_hashes(" \n", 3)) == 0


def test_half_of_the_hashes_is_not_over_half():
    assert simhash.fingerprint(np.array([1, 2], np.uint64)) == 0
    assert simhash.fingerprint(np.array([1, 3], np.uint64)) == 1


def test_anchors_lose_no_pair():
    random = np.random.default_rng(3)
    x = random.integers(0, 2**64, 300, np.uint64)
    for distance, threshold in ((0, 3), (1, 3), (2, 3), (3, 3), (4, 4), (2, 2), (5, 5)):
        y = x.copy()
        for i in range(len(x)):
            for bit in random.choice(64, distance, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(bit)
        row, anchor, near = simhash.anchors(x, threshold)
        row_y, anchor_y, near_y = simhash.anchors(y, threshold)
        for i in range(len(x)):
            mine = dict(zip(anchor[row == i].tolist(), near[row == i].tolist()))
            other = dict(zip(anchor_y[row_y == i].tolist(), near_y[row_y == i].tolist()))
            assert any(mine[a] or other[a] for a in mine.keys() & other.keys())


def test_groups_equal_brute_force_with_hot_anchors_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 8)
    monkeypatch.setattr(simhash, "PROBE", 1)
    random = np.random.default_rng(5)
    base = random.integers(0, 2**64, 6, np.uint64)
    fps = set()
    for b in base.tolist():
        for _ in range(40):
            flips = random.choice(64, random.integers(0, 7), replace=False)
            fps.add(b ^ sum(1 << int(i) for i in flips))
    signed = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    links = simhash.similar_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {r.node: r.root for r in simhash.connected_components(links).collect()}
    want = components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {x: found.get(x, x) for x in signed} == want


def test_near_groups_edges(documents):
    long = prose(1, 30_000)
    rows = [(5, None), (3, ""), (9, " \t "), (4, "Same words here now"), (2, "same WORDS here now"), (2, "same WORDS here now"),
            (None, "same words here now"), (7, long), (8, long), (None, "alone with no id at all")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(documents(rows)).collect()), key=str)
    want = [(5, 3), (3, 3), (9, 3), (4, 2), (2, 2), (2, 2), (None, 2), (7, 7), (8, 7), (None, None)]
    assert got == sorted(want, key=str)
    assert simhash.near_groups(documents([])).count() == 0


def near(texts):
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in texts]
    return components(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_one_row_of_each_group_stays(documents):
    original = prose(2, 4000).split()
    rows = [(10, " ".join(original))]
    for i in range(12):
        edited = list(original)
        edited[20 + 300 * i] = f"edit{i}"
        rows.append((11 + i, " ".join(edited)))
    rows += [(1, prose(3, 300)), (2, prose(9, 300)), (3, None), (4, ""), (None, ""), (2, prose(9, 300)), (None, "just one"), (None, "just one")]
    groups = near([t for _, t in rows])
    # The fingerprints of the edited texts are within three bits of one another, in chains.
    assert sum(root == 0 for i, root in groups.items() if i <= 12) > 8
    docs = documents(rows)
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    best = {}
    for i, root in groups.items():
        d = rows[i][0]
        best[root] = min(best.get(root, (True, 0)), (d is None, d or 0))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((None if none else d for none, d in best.values()), key=str)
    assert simhash.without_copies(documents([])).count() == 0


def test_copies_with_null_ids_and_unlike_texts_under_one_id(documents):
    one, two, three = (prose(s, 200) for s in (61, 62, 63))
    rows = [(None, one), (None, one.upper()), (7, two), (7, three), (7, three), (7, prose(64, 200)), (8, three.title()), (9, prose(65, 200))]
    kept = [(r.doc_id, r.text) for r in simhash.without_copies(documents(rows)).collect()]
    assert sorted(d for d, _ in kept if d) == [7, 7, 7, 9] and sum(d is None for d, _ in kept) == 1
    assert {t for d, t in kept if d == 7} == {two, three, prose(64, 200)}
