"""Toxic texts by logistic regression: FTRL-proximal over hashed word n-grams and skip-grams.

A text is the set of its features: words (runs of letters and digits in lower case), their first
4, 5 and 6 characters as plain stems, pairs of neighbouring words, and pairs with one or two words
left out between them. Each is hashed to one of 2^26 places. A place takes part if a
LEAST_SHARE of the labelled rows hold it, LEAST_ROWS at least (the commonest MOST_FEATURES of them).

Every round, shards of the labelled rows run the online update from the shared state: each
coordinate has its own rate ``alpha / (beta + sqrt(n))`` from its squared gradients ``n``, and its
weight is zero until the collected gradient ``z`` exceeds ``l1``. The shards' changes of (z, n) are
averaged by coordinate on the driver. What is left are some thousand weights, small enough for every task.

The model is fitted on about SAMPLE_ROWS labelled rows, taken by a hash of the id; everything is
scored. Bounds: the state has at most
MOST_FEATURES coordinates, and a round brings 12 bytes for each coordinate and shard to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, least_count, pieces

#: Labelled rows that the model is fitted on, about; rows of a shard, about; rounds over them.
SAMPLE_ROWS, SHARD_ROWS, ROUNDS = 20_000, 5_000, 10
#: Rows, and share of all of them, that must hold a feature; how many features there are at most.
LEAST_ROWS, LEAST_SHARE, MOST_FEATURES = 3, 0.001, 1 << 19
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.0
#: From this score on a text is predicted toxic.
TOXIC = 0.7
SPACE_BITS, SIEVE_BITS = 26, 22
STEMS, GAPS = (4, 5, 6), (1, 2, 3)
#: Words whose hashes a task remembers; features that it tallies at a time.
REMEMBERED, TALLIED = 1 << 18, 1 << 22

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Weights other than zero at their places (sorted), and the weight of every text."""

    places: np.ndarray
    weights: np.ndarray
    bias: float


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (unsigned, modulo 2^64)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Places of the features of texts; hashes of words are remembered from text to text."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.known = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)

    def _ids(self, text: str) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen, first = self.seen, len(self.seen)
        words = _WORD.findall(text.lower())
        fresh = list(set(words).difference(seen))
        if fresh:
            seen.update(zip(fresh, range(first, first + len(fresh))))
            digests = []
            for word in fresh:
                digests.append(xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 1))
                for n in STEMS:
                    # A word that is no longer than a stem has 0 for it, which means none.
                    digests.append(xxhash.xxh64_intdigest(word[:n].encode("utf-8", "replace"), n) if len(word) > n else 0)
            while len(self.known) < len(seen):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[first : len(seen)] = np.array(digests, np.uint64).reshape(-1, 1 + len(STEMS))
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def places(self, text: str | None) -> np.ndarray:
        """The places of a text's features, with repeats."""
        ids = self._ids(text) if text else np.empty(0, np.int64)
        if not len(ids):
            return np.empty(0, np.int64)
        hashes = self.known[ids, 0]
        table = self.known[np.unique(ids)]
        stems = table[:, 1:].ravel()
        found = [table[:, 0], stems[stems != 0]]
        for gap in GAPS:
            turned = (hashes[:-gap] << np.uint64(17)) | (hashes[:-gap] >> np.uint64(47))
            found.append(_mix(turned + hashes[gap:] + np.uint64(gap)))
        return (np.concatenate(found) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in pieces(batches):
        sets = [pa.array(np.unique(hasher.places(text.as_py())).astype(np.int32)) for text in batch.column("text")]
        ends = np.cumsum([0, *map(len, sets)])
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(sets) if sets else pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), held], names=["place", "label", "held"])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that the collected gradients stand for; the last coordinate (every text) has no ``l1``."""
    limit = np.full(len(z), L1)
    limit[-1] = 0.0
    return np.where(np.abs(z) <= limit, 0.0, -(z - np.sign(z) * limit) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def run_shard(rows: list[np.ndarray], labels: list[int], z: np.ndarray, n: np.ndarray) -> None:
    """The online update over the rows in order; ``z`` and ``n`` are changed in place."""
    last = len(z) - 1
    for held, label in zip(rows, labels):
        at = np.append(held, last)
        zs, ns = z[at], n[at]
        own = _weights(zs, ns)
        slope = probability(own.sum()) - label
        rate = (np.sqrt(ns + slope * slope) - np.sqrt(ns)) / ALPHA
        z[at] = zs + slope - rate * own
        n[at] = ns + slope * slope


def probability(total: float) -> float:
    return float(1 / (1 + np.exp(-min(max(total, -35.0), 35.0))))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column | str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, label) of about ``sample_rows`` rows: ids with a label for which ``learn`` holds.

    ``learn`` is a condition on ``doc_id``. An id with several labels counts as toxic if one of them
    is. The ids are chosen before the texts are read, so that the join has a small side.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marked.where(draw < sample_rows / max(total, sample_rows)).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("label"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id")


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of labelled rows (id, text, label); without rows every score is one half."""
    dealt = rows.select(F.xxhash64("id", "text").alias("place"), "label", "text")
    coded = cut_lineage(dealt.mapInArrow(_features, "place long, label int, held array<int>"))
    total = coded.count()
    shards, least = max(1, round(total / SHARD_ROWS)), max(LEAST_ROWS, int(total * LEAST_SHARE))
    coded = coded.withColumn("shard", F.pmod("place", F.lit(shards)))
    tallies = coded.select("held").mapInArrow(_tally, "slice int, low binary, n binary")
    counts = cut_lineage(tallies.groupBy("slice").applyInArrow(_merged(least), "place long, n long"))
    least = max(least, least_count(counts, MOST_FEATURES))
    places = np.sort(counts.where(F.col("n") >= least).select("place").toArrow().column(0).to_numpy()).astype(np.int64)
    kept = coded.select("shard", "place", "label", "held").mapInArrow(_coordinates(places), "shard int, place long, label int, held array<int>")
    packed = cut_lineage(kept.groupBy("shard").applyInArrow(_pack, "shard int, held array<int>, ends array<int>, labels array<int>"))
    z, n = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for _ in range(rounds):
        # One row a shard, of at most MOST_FEATURES coordinates; added in the same order every time.
        changes = packed.mapInArrow(_round(z, n), "shard int, at binary, z binary, n binary").toArrow().sort_by("shard")
        for change in changes.to_pylist():
            at = np.frombuffer(change["at"], np.int32)
            z[at] += np.frombuffer(change["z"], np.float32) / shards
            n[at] += np.frombuffer(change["n"], np.float32) / shards
    weights = _weights(z, n)
    kept = np.flatnonzero(weights[:-1])
    return Model(places[kept], weights[kept], float(weights[-1]))


def _known(own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the values of ``own`` stand in ``places`` (sorted); those that don't are left out."""
    at = np.searchsorted(places, own)
    inside = at < len(places)
    return at[inside][places[at[inside]] == own[inside]]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's rows hold each place, as arrays for each slice of 2^16 places."""
    parts, size = [], 0

    def out() -> pa.RecordBatch:
        places, n = np.unique(np.concatenate(parts), return_counts=True)
        slices, first = np.unique(places >> 16, return_index=True)
        ends = np.append(first[1:], len(places))
        low = [x.tobytes() for x in np.split((places & 0xFFFF).astype(np.uint16), first[1:])]
        many = [n[a:b].astype(np.uint32).tobytes() for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array(low, pa.binary()), pa.array(many, pa.binary())], names=["slice", "low", "n"])

    for batch in batches:
        for held in batch.column("held"):
            parts.append(held.values.to_numpy())
            size += len(parts[-1])
        if size > TALLIED:
            yield out()
            parts, size = [], 0
    if size:
        yield out()


def _merged(least: int):
    """The places of a slice that ``least`` rows hold, with their number."""

    def of(table: pa.Table) -> pa.Table:
        low, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", np.uint16), ("n", np.uint32)))
        total = np.bincount(low, n, 1 << 16).astype(np.int64)
        kept = np.flatnonzero(total >= least)
        return pa.table({"place": kept + (table.column("slice")[0].as_py() << 16), "n": total[kept]})

    return of


def _coordinates(places: np.ndarray):
    """Places to coordinates, those that don't take part left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_known(x.values.to_numpy(), places).astype(np.int32) for x in batch.column("held")]
            columns = [batch.column("shard").cast(pa.int32()), batch.column("place"), batch.column("label"), pa.array(held, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "label", "held"])

    return of


def _pack(table: pa.Table) -> pa.Table:
    """A shard's rows as one row: coordinates in a row, where each text ends, labels."""
    # In an order that only depends on ids and texts.
    table = table.sort_by([("place", "ascending"), ("label", "ascending")])
    rows = [x.values.to_numpy() for x in table.column("held")]
    ends = np.cumsum([len(r) for r in rows]).astype(np.int32)
    return pa.table({"shard": table.column("shard")[:1], "held": [np.concatenate(rows)], "ends": [ends], "labels": [table.column("label").to_numpy()]})


def _round(z: np.ndarray, n: np.ndarray):
    """The shards' changes of the state in one round."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, held, ends, labels in zip(*batch.columns):
                rows = np.split(held.values.to_numpy(), ends.values.to_numpy()[:-1])
                new_z, new_n = z.copy(), n.copy()
                run_shard(rows, labels.values.to_pylist(), new_z, new_n)
                at = np.flatnonzero((new_n != n) | (new_z != z))
                parts = at.astype(np.int32), (new_z[at] - z[at]).astype(np.float32), (new_n[at] - n[at]).astype(np.float32)
                columns = [pa.array([shard.as_py()], pa.int32()), *(pa.array([x.tobytes()]) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "at", "z", "n"])

    return of


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of ``docs`` (key, text): null and empty texts get the score of no feature."""
    places, weights, bias = model.places, model.weights, model.bias

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[places & ((1 << SIEVE_BITS) - 1)] = True
        for batch in pieces(batches):
            scores = []
            for text in batch.column("text"):
                own = hasher.places(text.as_py())
                own = np.unique(own[sieve[own & ((1 << SIEVE_BITS) - 1)]])
                scores.append(probability(bias + weights[_known(own, places)].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), "text").mapInArrow(of, f"{key} {kind}, score double")
