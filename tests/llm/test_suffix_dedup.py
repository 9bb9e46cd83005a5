from __future__ import annotations

from collections import Counter

import pytest
from llm.made import prose

from funnelwright.llm import suffix_dedup


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, int, bytes]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def rows() -> list[tuple]:
    shared, other = prose(1, 40), prose(2, 60)
    edited = [other[:k] + "#" + other[k + 1 :] for k in range(40, len(other) - 40, 45)]
    return [
        (1, prose(3, 50) + shared + prose(4, 50)),
        (2, shared + prose(5, 30)),
        (3, prose(6, 20) + " é " + shared[: len(shared) // 2]),
        (4, None),
        (5, ""),
        (None, prose(7, 60)),
        (7, prose(8, 60)),
        (7, prose(8, 60)),
        (8, "ab" * 300),
        (9, prose(9, 30) + prose(10, 30) + prose(9, 30)),
        (10, "short"),
        *((20 + i, x) for i, x in enumerate(edited)),
    ]


@pytest.mark.parametrize(("paired", "hot", "place"), [(64, 8192, 20), (1, 8192, 11), (1, 2, 20)])
def test_equals_brute_force(documents, monkeypatch, paired, hot, place):
    """Compared in pairs, counted in a task (with texts in pieces), and counted in a shuffle."""
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    monkeypatch.setattr(suffix_dedup, "PLACE", place)
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (400, 128, 4, "doc_id", hot))
    suffix_dedup._powers.cache_clear()
    data = rows()
    got = suffix_dedup.remove_repeats(documents(data), length=100, context=32, batches=3).collect()
    want = [(d, *x) for (d, *_), x in zip(data, brute([(r[1] or "").encode() for r in data], 100))]
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    suffix_dedup._powers.cache_clear()
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_empty_table(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_levels_merge_like_a_binary_counter(spark):
    levels: dict = {}
    for i in range(5):
        matched = suffix_dedup.add_batch(levels, spark.createDataFrame([(1,), (100 + i,)], "key long"))
        assert [r.key for r in matched.collect()] == ([1] if i else [])
    assert sorted(levels) == [0, 2]
    assert {r.key: r.n for r in levels[2].collect()} == {1: 4, 100: 1, 101: 1, 102: 1, 103: 1}
