"""Hidden Markov language model: class-based, trained by Baum-Welch, scored by the scaled forward recursion.

Tokens are the words of a text and one end. A word belongs to one class: the OWN commonest words
have classes of their own, the others share SUFFIXES classes by their last three bytes, so the
model is of bounded size while the word counts that it builds on grow with the corpus. The
probability of a text is that of its class sequence and end under the HMM, times that of each word
within its class, (c + 1) / (class tokens + class words + 1); all of it is learnt from the training
rows. Latent states come from STATES-state Baum-Welch: expected counts are added up within each task,
summed by class across partitions in a shuffle, and normalised on the driver. Each of the ROUNDS
rounds uses every training text, in windows of WINDOW tokens (a window after the first starts from
the occupancy of the states).
Scoring runs the exact recursion over whole texts.

The commonest words (of at most LONGEST bytes; as many as DICTIONARY without a tie) travel with the tasks; the other tokens
meet their counts in a shuffle join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, least_count, pieces, words

STATES, OWN, SUFFIXES = 8, 8192, 2048
DICTIONARY, LONGEST = 131_072, 64
WINDOW, ROUNDS = 256, 10
#: Steps between two scalings of the probabilities in training: a step's are above 1e-30, the smallest number is 1e-308.
SCALED = 8
SMOOTHING, SEED = 5.0, 11
#: Distinct words a task counts before it hands them on, and tokens it scores at a time.
DISTINCT, TOKENS = 400_000, 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    for batch in pieces(batches):
        for text in batch.column("text"):
            seen.update(words(text.as_py()))
            seen[b""] += 1
        if len(seen) > DISTINCT:
            yield out()
            seen.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over whole texts; the end of a text is the empty word."""
    return texts.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What the tasks need of the counts."""

    tokens: int
    distinct: int
    ends: int
    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def own(self) -> int:
        return min(OWN, len(self.words))

    def priors(self) -> np.ndarray:
        """Share of each class among the words."""
        share = np.concatenate([np.pad(self.counts[: self.own].astype(float), (0, OWN - self.own)), self.class_tokens]) + 1
        return share / share.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    suffix = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(SUFFIXES)).cast("int")
    end = F.octet_length("word") == 0
    total = counts.agg(F.sum("n"), F.count("*"), F.max(F.when(end, F.col("n")))).first()
    short = counts.where(~end & (F.octet_length("word") <= LONGEST))
    top = short.where(F.col("n") >= least_count(short, DICTIONARY)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    known, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    class_tokens, class_words = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for row in counts.where(~end).groupBy(suffix.alias("class")).agg(F.sum("n"), F.count("*")).collect():
        class_tokens[row[0]], class_words[row[0]] = row[1], row[2]
    # The commonest words have classes of their own.
    for word, count in zip(known[:OWN], n[:OWN].tolist()):
        at = zlib.crc32(word[-3:]) % SUFFIXES
        class_tokens[at] -= count
        class_words[at] -= 1
    return Vocabulary(total[0] or 0, total[1], total[2] or 0, known, n, class_tokens, class_words)


def _encode(vocabulary: Vocabulary):
    """Rows of class sequences, sums over the tokens of the dictionary, and the other tokens."""
    counts = np.append(vocabulary.counts.astype(float), 0.0)
    spread = -np.log10(vocabulary.class_tokens + vocabulary.class_words + 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {word: i for i, word in enumerate(vocabulary.words)}
        none = len(vocabulary.words)
        suffix_of = np.array([zlib.crc32(w[-3:]) % SUFFIXES for w in vocabulary.words] + [0])
        own = np.arange(none + 1) < vocabulary.own
        gain = np.log10(counts + 1)
        for batch in pieces(batches):
            n_tokens, known, base, inside, classes, rare = [], [], [], [], [], []
            for text in batch.column("text"):
                found = words(text.as_py())
                rank = np.fromiter(map(ranks.get, found, repeat(none)), np.int64, len(found))
                suffix, out = suffix_of[rank], np.flatnonzero(rank == none)
                others = [found[i] for i in out.tolist()]
                suffix[out] = [zlib.crc32(w[-3:]) % SUFFIXES for w in others]
                is_own = own[rank]
                n_tokens.append(len(found) + 1)
                known.append(len(found) - len(others) + (vocabulary.ends > 0))
                base.append(float(gain[rank].sum()) + float(np.log10(vocabulary.ends + 1)))
                inside.append(float((spread[suffix] + gain[rank])[~is_own].sum()))
                classes.append(np.where(is_own, rank, OWN + suffix).astype(np.uint16).tobytes())
                rare.append(others)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("learnt"),
                    batch.column("held_out"),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(inside, pa.float64()),
                    pa.array(classes, pa.binary()),
                    pa.array(rare, pa.list_(pa.binary())),
                ],
                names=["id", "learnt", "held_out", "n_tokens", "known", "base", "inside", "classes", "rare"],
            )

    return of


@dataclass
class Model:
    """start and step have a last column for the end of the text; occupancy starts later windows."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    occupancy: np.ndarray


def first_model(priors: np.ndarray, states: int = STATES) -> Model:
    """Every state near the common distribution, and more likely to stay than to change."""
    random = np.random.default_rng(SEED)
    emit = priors[:, None] * random.gamma(2.0, 0.5, (len(priors), states))
    step = np.full((states, states + 1), 0.1 / states)
    step[np.arange(states), np.arange(states)] += 0.899
    step[:, states] = 0.001
    start = np.append(np.full(states, 0.999 / states), 0.001)
    return Model(start, step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), np.full(states, 1 / states))


def expected_counts(
    model: Model, windows: list[tuple[np.ndarray, bool, bool]], room: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Baum-Welch counts of windows (classes, is first, is last): start, step, emit, and log-likelihood.

    All windows advance together, the longest first, so that those that go on are a prefix. Arrays have
    a row for each state: every step is a few operations along the windows. Probabilities are scaled at
    every SCALED-th step. ``room`` holds 3 * states numbers for each token, at least, and is overwritten.
    """
    states = len(model.step)
    moves, leave = model.step[:, :states], model.step[:, states : states + 1]
    onward, emit = np.ascontiguousarray(moves.T), np.ascontiguousarray(model.emit.T)
    windows = sorted(windows, key=lambda w: -len(w[0]))
    sizes = np.array([len(w[0]) for w in windows], np.int64)
    first, last = (np.array([w[k] for w in windows], bool) for k in (1, 2))
    starts, steps = np.zeros(states + 1), np.zeros((states, states + 1))
    starts[states] = np.count_nonzero(sizes == 0)
    longest, tokens = int(sizes.max(initial=0)), int(sizes.sum())
    if not tokens:
        return starts, steps, np.zeros_like(model.emit), 0.0
    active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")
    upto = np.cumsum(active).tolist()
    active = active.tolist()
    flat, begin = np.concatenate([w[0] for w in windows]).astype(np.int64), np.cumsum(sizes) - sizes
    classes = np.concatenate([flat.take(begin[: active[t]] + t) for t in range(longest)])
    if room is None:
        room = np.empty(3 * states * tokens)
    # Each step's block has a row for each state; the rows of the found counts go through all steps.
    ahead, given = (
        [part[(end - n) * states : end * states].reshape(states, n) for n, end in zip(active[:-1], upto)]
        for part in (room[: tokens * states], room[tokens * states : 2 * tokens * states])
    )
    found = room[2 * tokens * states : 3 * tokens * states].reshape(states, tokens)
    log = 0.0
    for t in range(longest):
        n, before, now = active[t], ahead[t], given[t]
        emit.take(classes[upto[t] - n : upto[t]], axis=1, out=now, mode="clip")
        if t == 0:
            np.multiply(np.where(first[:n], model.start[:states, None], model.occupancy[:, None]), now, out=before)
        else:
            np.matmul(onward, ahead[t - 1][:, :n], out=before)
            before *= now
        if t % SCALED == 0:
            # A token's emissions over its scale: the backward pass needs the same.
            total = before.sum(axis=0)
            over = 1 / total
            before *= over
            now *= over
            log += float(np.log(total).sum())
        if active[t + 1] < n:
            log += float(np.log(before[:, active[t + 1] :].sum(axis=0)).sum())
    behind = np.zeros((states, 0))
    for t in range(longest - 1, -1, -1):
        n, m = active[t], active[t + 1]
        back = behind
        if m:
            carried = given[t + 1]
            carried *= behind
            steps[:, :states] += ahead[t][:, :m] @ carried.T
            back = moves @ carried
        state = found[:, upto[t] - n : upto[t]]
        if m < n:
            ends = np.where(last[m:n], leave, 1.0)
            ends /= np.maximum((ahead[t][:, m:] * ends).sum(axis=0), 1e-300)
            behind = np.concatenate([back, ends], axis=1)
        else:
            behind = back
        # Their sum over the states is 1 at every step, as it is where a window ends.
        np.multiply(ahead[t], behind, out=state)
        if m < n:
            steps[:, states] += state[:, m:][:, last[m:n]].sum(axis=1)
        if t == 0:
            starts[:states] += state[:, first[:n]].sum(axis=1)
    steps[:, :states] *= moves
    counted = np.column_stack([np.bincount(classes, found[s], len(model.emit)) for s in range(states)])
    return starts, steps, counted, log


def windows_of(classes: np.ndarray) -> list[tuple[np.ndarray, bool, bool]]:
    n = len(classes)
    if not n:
        return [(classes, True, True)]
    return [(classes[at : at + WINDOW], at == 0, at + WINDOW >= n) for at in range(0, n, WINDOW)]


def _expect(model: Model):
    states = len(model.step)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, steps, emit = np.zeros(states + 1), np.zeros((states, states + 1)), np.zeros_like(model.emit)
        held: list[tuple[np.ndarray, bool, bool]] = []
        size, room = 0, np.empty(0)

        def add() -> None:
            nonlocal room
            if len(room) < 3 * states * size:
                room = np.empty(3 * states * size)
            for total, more in zip((starts, steps, emit), expected_counts(model, held, room)):
                total += more
            held.clear()

        for batch in batches:
            for x in batch.column("classes"):
                classes = np.frombuffer(x.as_py(), np.uint16)
                for window in windows_of(classes):
                    held.append(window)
                    size += len(window[0])
                    if size >= TOKENS // 8:
                        add()
                        size = 0
        if held:
            add()
        # Classes from 0, then the steps (-1 - from state), and the starts last; the end is column "end".
        table = np.vstack([np.column_stack([emit, np.zeros(len(emit))]), steps, starts[None, :]])
        rows = [*range(len(emit)), *(-1 - s for s in range(states)), -1 - states]
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(rows, np.int64)[used]), *(pa.array(table[used, k]) for k in range(states + 1))],
            names=["row", *(f"s{k}" for k in range(states + 1))],
        )

    return of


def baum_welch(texts: DataFrame, model: Model, priors: np.ndarray) -> Model:
    """One round over class sequences (column classes)."""
    states = len(model.step)
    names = [f"s{k}" for k in range(states + 1)]
    schema = ", ".join(["row long", *(f"{x} double" for x in names)])
    parts = texts.select("classes").mapInArrow(_expect(model), schema)
    found = parts.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    rows = found.column("row").to_numpy()
    values = np.column_stack([found.column(x).to_numpy() for x in names]) if len(rows) else np.zeros((0, states + 1))
    emit, steps, starts = np.zeros_like(model.emit), np.zeros_like(model.step), np.zeros(states + 1)
    emit[rows[rows >= 0]] = values[rows >= 0, :states]
    for row, value in zip(rows.tolist(), values):
        if -states <= row < 0:
            steps[-1 - row] = value
        elif row == -1 - states:
            starts = value
    occupancy = emit.sum(axis=0) + 1
    emit += SMOOTHING * len(priors) / 100 * priors[:, None]
    steps += 0.01
    starts += 0.01
    return Model(
        starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), occupancy / occupancy.sum()
    )


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each class sequence and its end: the scaled forward recursion.

    All texts advance together, the longest first, so that those that go on are a prefix.
    """
    states = len(model.step)
    moves, leave, emit = model.step[:, :states].T.copy(), model.step[:, states], np.ascontiguousarray(model.emit.T)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64) if texts else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    log = np.zeros(len(texts))
    log[sizes == 0] = np.log(model.start[states])
    now = np.zeros((states, 0))
    stop = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), side="left")
    for t in range(int(sizes.max(initial=0))):
        n = int(stop[t])
        own = emit.take(flat[begin[:n] + t], axis=1)
        now = own * (model.start[:states, None] if t == 0 else moves @ now[:, :n])
        total = now.sum(axis=0)
        now /= total
        log[:n] += np.log(total)
        gone = int(stop[t + 1])
        if gone < n:
            log[gone:n] += np.log(leave @ now[:, gone:])
    out = np.empty(len(texts))
    out[order] = log
    return out


def _score(model: Model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            log = log_likelihoods(model, [x for _, x in held]) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), pa.array(log)], names=["row", "hidden"])

        for batch in batches:
            for row, x in zip(batch.column("row"), batch.column("classes")):
                held.append((row.as_py(), np.frombuffer(x.as_py(), np.uint16)))
                size += len(held[-1][1])
                if size >= 2 * TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return of


def score(docs: DataFrame, learnt: Column, held_out: Column, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``learnt`` marks the training rows. ``score`` is the log10 probability of the whole text under
    the model, ``base_score`` that under add-one unigrams of the training tokens. Null texts are
    empty (one end); repeated rows, null ids and long texts are rows like any other. Without
    training rows the counts are zero and the model is its starting point.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(
        F.col(key).alias("id"), "text", F.coalesce(learnt, F.lit(False)).alias("learnt"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    counts = cut_lineage(word_counts(source.where("learnt")).where("n > 0"))
    known = vocabulary(counts)
    schema = (
        f"id {kind}, learnt boolean, held_out boolean, n_tokens long, known long, base double, inside double, "
        "classes binary, rare array<binary>"
    )
    coded = source.mapInArrow(_encode(known), schema).withColumn("row", F.monotonically_increasing_id())
    coded = cut_lineage(coded)
    training, priors = coded.where("learnt"), known.priors()
    model = first_model(priors)
    for _ in range(ROUNDS):
        model = baum_welch(training, model, priors)
    hidden = coded.select("row", "classes").mapInArrow(_score(model), "row long, hidden double")
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(n + 1)).alias("gain"), F.count_if(n > 0).alias("also_known"))
    total = known.tokens + known.distinct + 1
    gain = F.coalesce("gain", F.lit(0.0))
    return (
        coded.select("row", "id", "held_out", "n_tokens", "known", "base", "inside")
        .join(hidden, "row")
        .join(rare, "row", "left")
        .select(
            F.col("id").alias(key),
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
            F.lit(known.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + gain - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
            (F.col("hidden") + F.col("inside") + gain).alias("score"),
        )
    )
