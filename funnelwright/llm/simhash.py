"""Near-duplicates by SimHash and anchor-point covering.

A fingerprint has 64 bits. Its anchors are the codewords of a covering code: the binary Golay code
(23 bits, covering radius 3, perfect), used twice, covers bits 0-45 with 2^24 anchors. Every point
has a home anchor within the covering radius. For two fingerprints x, y with at most t differing
bits, let z be a point on a shortest way from x to y, t // 2 steps from x. The home anchor of z lies
within the covering radius plus t // 2 of x and the covering radius plus t - t // 2 of y, counted
block by block. So each fingerprint is replicated to every anchor within the covering radius plus
its share of the threshold, and two fingerprints need comparing only at anchors where one of them
has the smaller share: no link is lost. Sharing the threshold between both sides takes 68
copies of a fingerprint instead of 325 with all of it on one side.

Exact copies meet before that: only distinct fingerprints are replicated. Links at one anchor are
reduced to a forest before they leave the task. Anchors with many fingerprints (found from a hashed
64th, which decides about balance only) are split into pairs of parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import connected_components, cut_lineage, forest, fresh, pieces, remembered, row_hash, words

SEED = 42
THRESHOLD = 3
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0b110001110101
BLOCK, CHECK_BITS, RADIUS = 23, 11, 3
BLOCKS = 2
#: Fingerprints at an anchor beyond which it is split, and the share of them that finds such anchors.
HOT_ROWS, PROBE = 4096, 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; a shorter text gives one run."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(found)) - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[start : start + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) for every document; null and empty texts get fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [fingerprint(shingle_hashes(x.as_py(), width)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(values, np.uint64).view(np.int64))], names=[key, "fp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(of, f"{key} {kind}, fp long")


@remembered
def _cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word; for each syndrome the ways to codewords, and their levels.

    A way is the bits to flip; its level is how far it goes beyond the covering radius.
    """
    step = []
    for i in range(BLOCK):
        r = 1 << i
        for bit in range(i, CHECK_BITS - 1, -1):
            if r >> bit & 1:
                r ^= GOLAY << (bit - CHECK_BITS)
        step.append(r)
    by_byte = np.zeros((3, 256), np.uint32)
    for place, value in itertools.product(range(3), range(256)):
        for bit in range(8):
            if value >> bit & 1 and 8 * place + bit < BLOCK:
                by_byte[place, value] ^= step[8 * place + bit]
    ways: list[list[tuple[int, int]]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(RADIUS + reach + 1):
        for chosen in itertools.combinations(range(BLOCK), weight):
            syndrome = flips = 0
            for i in chosen:
                syndrome ^= step[i]
                flips |= 1 << i
            ways[syndrome].append((max(0, weight - RADIUS), flips))
    most = max(map(len, ways))
    flips = np.array([[f for _, f in w] + [0] * (most - len(w)) for w in ways], np.uint32)
    level = np.array([[v for v, _ in w] + [99] * (most - len(w)) for w in ways], np.uint8)
    return by_byte, flips, level


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: row, anchor, and whether the anchor is within the smaller share."""
    lower, upper = threshold // 2, threshold - threshold // 2
    by_byte, flips, level = _cosets(upper)
    row, key, used = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.uint8)
    for block in range(BLOCKS):
        word = ((fps >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)
        syndrome = by_byte[0, word & 255] ^ by_byte[1, word >> 8 & 255] ^ by_byte[2, word >> 16]
        total = used[:, None] + level[syndrome[row]]
        at, way = np.nonzero(total <= upper)
        message = (word[row[at]] ^ flips[syndrome[row[at]], way]) >> CHECK_BITS
        key = key[at] << (BLOCK - CHECK_BITS) | message
        row, used = row[at], total[at, way]
    return row, key, used <= lower


def _replicate(threshold: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(values), 2048):
                part = values[start : start + 2048]
                row, key, near = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(part[row].view(np.int64)), pa.array(near)],
                    names=["anchor", "fp", "near"],
                )

    return of


def links_within(group: np.ndarray, fps: np.ndarray, near: np.ndarray, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of one group (rows sorted by group), one of the two near."""
    found_a, found_b, held = [], [], 0
    left, step = np.arange(max(0, len(fps) - 1)), 1
    while len(left := left[left + step < len(fps)]):
        left = left[group[left] == group[left + step]]
        for start in range(0, len(left), 1 << 20):
            i = left[start : start + (1 << 20)]
            j = i + step
            hit = (np.bitwise_count(fps[i] ^ fps[j]) <= accept) & (near[i] | near[j])
            found_a.append(fps[i[hit]])
            found_b.append(fps[j[hit]])
            held += len(found_a[-1])
        if held > 1 << 20:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        step += 1
    if not found_a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _compare(accept: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_within(columns[0], columns[1].view(np.uint64), columns[2], accept)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            # One number for a group (anchor, part): anchors have 24 bits.
            now = [now[0] << 32 | now[1], now[2], now[3]]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            last = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if last:
                yield links([x[:last] for x in rest])
                rest = [x[last:] for x in rest]
        if rest is not None:
            yield links(rest)

    return of


def similar_pairs(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``threshold`` bits apart.

    Enough of the links that the same fingerprints are connected as by all of them.
    """
    replicas = distinct.mapInArrow(_replicate(threshold), "anchor long, fp long, near boolean")
    probe = distinct.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(PROBE)) == 0)
    hot = (
        probe.mapInArrow(_replicate(threshold), "anchor long, fp long, near boolean")
        .groupBy("anchor")
        .count()
        .where(F.col("count") >= HOT_ROWS // PROBE)
        .select("anchor", F.ceil(F.col("count") * PROBE / HOT_ROWS + 1).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64(F.lit(2), "fp"), F.col("parts")).cast("int")
    # A part meets every part of its anchor, itself included, at the place of the pair.
    places = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part),
    )
    spread = replicas.join(cut_lineage(hot), "anchor", "left").select(
        "anchor",
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(places)).alias("place"),
        "fp",
        "near",
    )
    dealt = spread.repartition("anchor", "place").sortWithinPartitions("anchor", "place")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): documents connected by fingerprints at most ``threshold`` bits apart.

    ``component_id`` is the smallest key that a document reaches, itself included. Null and empty
    texts share fingerprint 0 and are linked like any other; a null key takes part but is never the
    smallest (a component of null keys only has a null id). Repeated rows each give a row.
    """
    marked = cut_lineage(fingerprints(docs, width, key))
    distinct = marked.groupBy("fp").agg(F.min(key).alias("first"))
    roots = connected_components(similar_pairs(distinct.select("fp"), threshold))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_copies(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``: the one with the smallest key.

    Null keys come last, so a group of null keys keeps one row too. Rows of one key with unlike
    texts are told apart by a hash of both; of equal rows one stays.
    """
    own, row = fresh(docs, "own"), fresh(docs, "row")
    named = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), row_hash(key).alias("row"))
    groups = near_groups(docs.withColumn(own, named), width, threshold, own)
    first = groups.where(F.col(own) == F.col("component_id")).groupBy(F.col(f"{own}.row").alias(row))
    chosen = cut_lineage(first.agg((F.count("*") > 1).alias(own)))
    kept = docs.withColumn(row, row_hash(key)).join(chosen, row)
    # Only rows that occur again are made distinct.
    single, several = kept.where(~F.col(own)), kept.where(F.col(own)).dropDuplicates([row])
    return single.union(several).select(docs.columns)
