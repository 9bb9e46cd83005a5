from __future__ import annotations

import random

import numpy as np
from llm.made import prose

from funnelwright.llm import decontam


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_common_subsequence():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(draw.randrange(0, 90))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == brute_lcs(a, b)


def test_answers():
    assert decontam.answer_of("What is it? It is a thing.", None) == [b"it", b"is", b"a", b"thing."]
    assert decontam.answer_of("One two three four five six", None) == b"one two three four five six".split()
    assert decontam.answer_of("Q?", "Forty Two") == [b"forty", b"two"]


def test_leaks(spark, documents):
    items = [prose(9100 + i, 15 + 4 * i) + ". Answer " + prose(9200 + i, 4) + "." for i in range(10)]
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, items[0])], "item_id long, text string")
    rows = [(i, prose(i, 30 + 11 * (i % 17))) for i in range(200)]
    for i, item in enumerate(items):
        rows.append((1000 + i, f"{prose(300 + i, 5 * i)} {item.upper()} {prose(400 + i, 60)}"))
    changed = items[9].split()
    for k in (3, 11, 19, 27):
        changed[k] = "changed"
    rows += [(1100, prose(500, 90) + " " + " ".join(changed)), (None, items[3]), (1101, None), (1102, ""), (1000, rows[200][1]),
             (1103, prose(501, 20_000) + " " + items[5] + " " + prose(502, 9000))]
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(documents(rows), benchmark).collect()]
    want = [(1000 + i, i) for i in range(10)] + [(1000, 0), (1000, 52), (1000, 52), (1100, 9), (None, 3), (1103, 5)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(documents([]), none).count() == 0
    assert decontam.leaks(documents([(1, "some text")]), none).count() == 0
    assert decontam.leaks(documents([(1, None)]), spark.createDataFrame([(1, "an item")], "item_id long, text string")).count() == 0


def test_short_items_paraphrases_and_middles_equal_brute_force(spark, documents):
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(10**6)}"
    items = [[word() for _ in range(n)] for n in (6, 8, 10, 12, 15, 30, 30, 30, 30, 90, 120) for _ in range(3)]
    rows = []
    for k, item in enumerate(items):
        held = list(item)
        if len(item) == 30:
            for at in draw.sample(range(25), 6 + k % 4 * 2):
                held[at] = word()
        elif len(item) > 30:
            held = held[len(item) // 10 : -len(item) // 10]
        rows.append((k, " ".join([*(word() for _ in range(40 + 5 * k)), *held, *(word() for _ in range(60))])))
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(30)]
    want = set()
    for doc, text in rows:
        found = text.encode().split()
        for n, item in enumerate(items):
            item = [w.encode() for w in item]
            share = decontam.common_subsequence(item, found) / len(item)
            answer = item[-4:]
            if share >= 0.8 or (share >= 0.6 and decontam.common_subsequence(answer, found) >= 0.8 * len(answer)):
                want.add((doc, n))
    benchmark = spark.createDataFrame([(n, " ".join(x), " ".join(x[-4:])) for n, x in enumerate(items)], "item_id long, text string, answer string")
    assert len(want) == len(items)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(documents(rows), benchmark).collect()} == want


def test_axes_come_from_every_document(spark, monkeypatch):
    fitted = []
    real = decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda docs, *a, **k: fitted.append(docs.count()) or real(docs, *a, **k))
    # Above the 20,000 documents to which a sample was cut before.
    docs = spark.range(20_600).selectExpr("id as doc_id", "concat('word', id % 90, ' other', id % 70) as text")
    benchmark = spark.createDataFrame([(1, "word1 other1")], "item_id long, text string")
    decontam.leaks(docs, benchmark)
    assert fitted == [20_600]


def test_axes_equal_a_dense_matrix_and_little_is_written(spark, documents, monkeypatch):
    written, real = [], decontam.cut_lineage
    monkeypatch.setattr(decontam, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    axes, found = [], decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda docs, w, *a: axes.append((w, found(docs, w, *a))) or axes[-1][1])
    draw = random.Random(8)
    texts = [" ".join(f"w{int(draw.expovariate(0.02))}" for _ in range(n)) for n in [0, 1, 23, 24, 25, 400, *range(30, 130)]]
    decontam.leaks(documents([*enumerate(texts), (None, None)]), spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string"))
    weights, got = axes[0]
    rows = []
    for text in texts:
        cols = decontam.columns_of(decontam.words(text))
        for at in range(0, len(cols), decontam.WIDE):
            row = np.bincount(cols[at : at + decontam.WIDE], minlength=decontam.TERMS) * weights
            rows.append(row / max(np.linalg.norm(row), 1e-12))
    matrix = np.array(rows)
    block = np.random.default_rng(decontam.SEED).standard_normal((decontam.TERMS, decontam.RANK + decontam.OVERSAMPLE))
    basis, _ = np.linalg.qr(matrix.T @ (matrix @ block))
    squares, turn = np.linalg.eigh((matrix @ basis).T @ (matrix @ basis))
    want = basis @ turn[:, ::-1][:, : decontam.RANK] / np.sqrt(squares[::-1][: decontam.RANK])
    # Axes may point either way.
    assert np.allclose((matrix @ got) @ (matrix @ got).T, (matrix @ want) @ (matrix @ want).T, atol=1e-3)
    kinds = [(c, f.dataType.simpleString()) for c, f in zip(written[0].columns, written[0].schema.fields)]
    size = sum(r[0] or 0 for c, kind in kinds if kind == "binary" for r in written[0].selectExpr(f"sum(octet_length({c}))").collect())
    assert size <= 2 * sum(len(x.split()) for x in texts)


def test_hashes_of_whole_texts():
    texts = [b"", b" \t", b"one two\x0bthree  ", "é ü x ".encode(), b"a" * 64 + b" " + b"b" * 65 + b" " + b"c" * 5000 + b" d", b"x"]
    hashes, begin = decontam.hashed(texts)
    for text, at, end in zip(texts, begin, begin[1:]):
        assert hashes[at:end].tolist() == decontam.hashes_of(text.split()).tolist()
    assert len(hashes) == begin[-1]
    assert [len(x) for x in decontam.hashed([])] == [0, 1]
