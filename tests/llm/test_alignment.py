from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from funnelwright.llm import alignment
from tests.llm.made import prose

TOKENS = alignment.Tokens(f"{alignment.TOKENIZERS}/{alignment.BYTE_FILE}", f"{alignment.TOKENIZERS}/{alignment.PIECE_FILE}")
TEXTS = [
    None, "", " ", "  two  spaces ", "\n", "plain words here", "plain words here", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café Straße", "日本語 and emoji 👩‍👩‍👧 ok",
    "a b c", "ﬁ ligature é", "x" * 300, "I'll we've 12345 don't!", "tab\there", "a ▁ b", "\u0000 null", "Ünïcödé ʘ ɐ", prose(3, 900),
]


def spans(ids, data_of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(data_of[i]), i))
        at += len(data_of[i])
    return out


def brute(texts):
    """The contract's columns from every pair of tokens, one text at a time."""
    linked, counted = [], Counter()
    for text in texts:
        a = TOKENS.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = TOKENS.b.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(TOKENS.bytes_a[i] for i in a) != data or b"".join(TOKENS.bytes_b[i] for i in b) != data:
            linked.append(None)
            continue
        a, b = spans(a, TOKENS.bytes_a), spans(b, TOKENS.bytes_b)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, start = [], 0
        for end in ends:
            inside = lambda side: ",".join(str(i) for s, e, i in side if start <= s and e <= end)  # noqa: B023, E731
            groups.append(inside(a) + "|" + inside(b))
            start = end
        links = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e]
        counted.update(links)
        linked.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counted.items():
        best[y] = max(best[y], n)
    out = []
    for row in linked:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links, digest = row
        out.append((n_a, n_b, groups, len(links), sum(counted[p] == best[p[1]] for p in links), sum(counted[p] for p in links), digest))
    return out


def got(df):
    rows = df.orderBy("doc_id").collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_groups_of_random_ends():
    for seed in range(300):
        draw = random.Random(seed)
        size, share = draw.randint(1, 60), draw.choice([0.2, 0.6, 0.95])
        a, b = (sorted({*(i for i in range(1, size) if draw.random() < share), size}) for _ in range(2))
        cut = []
        for from_a, to_a, from_b, to_b in alignment.align(a, b):
            if a[from_a] == b[from_b]:
                assert a[from_a:to_a] == b[from_b:to_b]
                cut += a[from_a:to_a]
            else:
                cut.append(a[to_a - 1])
                assert a[to_a - 1] == b[to_b - 1] and not {*a[from_a : to_a - 1]} & {*b[from_b : to_b - 1]}
        assert cut == sorted({*a} & {*b})


def test_words_encode_as_the_whole_text():
    draw, letters = random.Random(6), ["a", "B", "é", "日", "▁", "\n", "\t", "0", ".", "'", "ﬁ", "\u0301", "\u3000", " ", " ", " "]
    assert TOKENS.by_word
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 14)))
        whole = TOKENS.b.encode(text)
        same = b"".join(TOKENS.bytes_b[i] for i in whole) == (" " + text).encode()
        assert TOKENS.encode_b(text) == (whole if same else None), repr(text)


def test_fast_encoder_cuts_alike():
    assert TOKENS.fast
    for code in range(0x250):
        text = f"a {chr(code)} b{chr(code)}{chr(code)}1 {chr(code)}{chr(code)}c{chr(code)}"
        assert TOKENS.fast.encode_ordinary(text) == TOKENS.a.encode(text, add_special_tokens=False).ids, code


@pytest.mark.parametrize("strip", [1 << 16, 40])
def test_whole_results(spark, documents, monkeypatch, strip):
    monkeypatch.setattr(alignment, "STRIP", strip)
    docs = documents(list(enumerate(TEXTS)))
    assert got(alignment.linked(docs)) == brute(TEXTS)


def test_rare_pairs_are_joined(documents, monkeypatch):
    monkeypatch.setattr(alignment, "COMMON", 30)
    texts = [prose(i, 200) for i in range(12)] + TEXTS
    assert got(alignment.linked(documents(list(enumerate(texts))))) == brute(texts)


def test_repeated_and_null_ids(documents):
    rows = [(None, "one two"), (1, "one two"), (1, "three"), (1, "one two")]
    result = sorted(((r.doc_id, r.n_a, r.n_links) for r in alignment.linked(documents(rows)).collect()), key=repr)
    assert [d for d, _, _ in result] == [1, 1, 1, None] and all(n for _, n, _ in result)
    assert alignment.linked(documents([])).count() == 0


def test_pairs_name_the_tokens(documents):
    rows = alignment.encoded(documents([(1, "plain words")])).collect()
    pairs = [(TOKENS.bytes_a[p >> alignment.B_BITS], TOKENS.bytes_b[p % (1 << alignment.B_BITS)]) for p in rows[0].pairs]
    assert sorted(pairs) == [(b" plain", b" plain"), (b" words", b" words")]


def fresh_tokens():
    return alignment.Tokens(f"{alignment.TOKENIZERS}/{alignment.BYTE_FILE}", f"{alignment.TOKENIZERS}/{alignment.PIECE_FILE}")


def listed(tokens, texts):
    return [(*row, pairs.tolist()) for *row, pairs in tokens.links(texts)]


def test_a_word_is_aligned_once(monkeypatch):
    seen, whole = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda a, b: seen.append(len(a)) or whole(a, b))
    tokens = fresh_tokens()
    first = listed(tokens, ["plainly worded texts", "texts worded plainly"] * 50)
    once = len(tokens.encode_a(" plainly worded texts"))
    assert sum(seen) == once and first[0][:3] == first[1][:3] and first[0][3] != first[1][3]
    listed(tokens, ["worded texts"])
    assert sum(seen) == once


@pytest.mark.parametrize(("strip", "at_once", "remembered"), [(1 << 16, 1 << 20, 1 << 18), (12, 40, 16)])
def test_words_align_as_the_whole_text(monkeypatch, strip, at_once, remembered):
    draw = random.Random(8)
    letters = ["a", "B", "é", "日", "▁", "\n", "\t", "0", ".", "'s", "ﬁ", "\u0301", "\u3000", "\u0085", "\x1c", "<|endoftext|>", "ab", "cd", "  "] + [" "] * 6
    texts = [None, "", *("".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(4000)), "", "x y"]
    tokens, plain = fresh_tokens(), fresh_tokens()
    assert tokens.by_words
    plain.by_words = False
    want = listed(plain, texts)
    assert {bool(r[0]) for r in want} == {True, False}
    for name, value in (("STRIP", strip), ("AT_ONCE", at_once), ("REMEMBERED", remembered)):
        monkeypatch.setattr(alignment, name, value)
    assert listed(tokens, texts) == want
