from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from funnelwright.llm import conversations
from funnelwright.llm.conversations import Row

WANTED = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, [(role, text)]) by uniform-cost search over (cost, audit); rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    seen = {}
    while heap:
        cost, audit, at, made, out = heappop(heap)
        if at == len(rows) and WANTED.match(made):
            return cost, audit, list(out)
        # What may follow depends on the row and on the last initial only.
        key = (at, made[-1:], bool(made))
        if key in seen:
            continue
        seen[key] = cost
        for role in ("user", "assistant"):
            step(heap, cost + 5, audit + "I", at, made, out, role, "")
        if at < len(rows):
            role, text, fault = rows[at]
            heappush(heap, (cost + 2, audit + "D", at + 1, made, out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            step(heap, cost + extra, audit + "K", at + 1, made, out, role, text)
            for given in ("user", "assistant"):
                step(heap, cost + extra + 1, audit + "R", at + 1, made, out, given, text)


def step(heap, cost, audit, at, made, out, role, text):
    grown = made + role[:1]
    if len(role) and (grown in ("s", "u") or grown[-2:] in ("su", "ua", "au") and "s" not in grown[1:]):
        heappush(heap, (cost, audit, at, grown, (*out, (role, text))))


def brute(rows):
    """The contract's columns, a conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = lambda x: " " if x is None else str(x)
            kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faulty, before = [], set()
        for turn, role, text in kept:
            last = BLANK.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in before else "truncated" if last[0] not in ".!?" else ""
            before.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, left = cheapest(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        )
    return out


def columns(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", range(300))
def test_search_is_uniform_cost_search(seed):
    draw = random.Random(seed)
    faults = draw.choice([["", "", "", "truncated"], ["", "blank", "truncated", "duplicate"]])
    given = [(draw.choice(["user", "assistant", "system", "tool", " "][: draw.randint(2, 5)]), "x", draw.choice(faults)) for _ in range(draw.randint(0, 9))]
    rows = [Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, _, fault in given]
    assert conversations.search(rows) == cheapest(given)[:2]


def test_floor_never_passes_the_cost():
    for seed in range(200):
        draw = random.Random(seed)
        rows = [Row(draw.choice("suat"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(draw.randint(0, 12))]
        assert conversations.floors(rows)[0] <= conversations.search(rows)[0]


def made(seed, convs, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \t\n", "So!", "a.b", "Long " * 50 + ".", "é.", "x" * 3]
    rows = []
    for conv in convs:
        n = draw.randint(1, most)
        for turn in range(n):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.2 else ("system" if turn == 0 and n % 3 == 0 else ("user", "assistant")[turn % 2])
            text = f"{draw.choice(texts)}{turn if draw.random() < 0.7 else ''}{draw.choice(['.', '', '?'])}"
            rows.append((conv, turn + draw.randint(0, 1) if draw.random() < 0.9 else None, role if draw.random() < 0.97 else None, text if draw.random() < 0.97 else None))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, block int, part int, lines int"


def repaired(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    return columns(conversations.repair(conversations.damaged(df)).digests())


def test_whole_results(spark):
    rows = made(1, [*range(60), None], 9)
    rows += rows[:20] + [(70, 1, "user", "Hi."), (71, None, None, None), (72, 5, "", "x.")]
    assert repaired(spark, rows) == brute(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    rows = made(2, [1, 2, 3], 60) + made(3, range(4, 12), 8)
    monkeypatch.setattr(conversations, "BLOCK", 5)
    assert repaired(spark, rows) == brute(rows)
    monkeypatch.setattr(conversations, "BLOCK_CHARS", 40)
    assert repaired(spark, rows) == brute(rows)


def test_empty_dropped_and_copied(spark):
    assert repaired(spark, []) == {}
    dropped = [(c, t, "user", "Hi.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = dropped + [(1000, 3, "user", "Same.")] * 300 + [(1000, 4, "assistant", "Same.")] * 2
    got = repaired(spark, rows)
    assert dropped and got == brute(rows)
    assert got[dropped[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_lines(spark):
    rows = [(5, 0, "user", "Hi."), (5, 1, "user", "Well?"), (5, 2, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    fixed = conversations.repair(df)
    lines = [(x.role, x.text) for r in [*fixed.short.collect(), *fixed.long_lines.orderBy("part", "block").collect()] for x in r.lines]
    assert lines == [("user", "Well?"), ("assistant", "Yes.")]
    assert [(r.cost, r.audit) for r in fixed.summary.collect()] == [(2, "DKK")]
