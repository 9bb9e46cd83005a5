"""Repeated byte strings of at least ``length`` bytes, removed by digests of sampled suffixes.

Context digests that are counted and joined stand in for suffix arrays: no run keeps positions or
lexical order, and no longest common prefix is read off a merge. Only the logarithmic family of
runs is that of an index of suffix arrays.

Sampling. Each window of ``length`` bytes names one of the suffixes that start in it: the one whose
first ``context`` bytes have the smallest hash (the leftmost of equals). Equal windows name the same
place, so it is enough to index the named suffixes, one in about 137 bytes. The windows that name a
suffix are consecutive; together they are its region.

Index family. A batch of documents gives one run: its suffixes in the order of their first
``context`` bytes (of their digest, the same order in all runs), a row for each distinct one. A new
run is merge-scanned against every level; suffixes found there or twice in the run have a long match
in common at least over the context. Then equal-sized levels are merged, as in a binary counter, so
a suffix is rewritten a logarithmic number of times.

Spans. Matched suffixes with equal regions are wholly repeated. The rest are compared byte by byte
with the distinct regions at the same suffix, to the left and to the right: a common extension
(left, right) repeats every window inside. Suffixes with many distinct regions go another, equally
exact way: each window is counted by its digest. Digests have 64 bits for the order and 64
more for regions and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, pieces, remembered, row_hash

LENGTH, CONTEXT, BATCHES = 400, 128, 4
#: Windows of a long text that a task works on at a time; a place in them takes PLACE bits.
PLACE = 20
#: Distinct regions at one suffix beyond which their windows are counted by digest instead of
#: compared in pairs, and beyond which they are counted in a shuffle instead of one task.
PAIRED, HOT_REGIONS = 64, 8192


@remembered
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd base and of its inverse, modulo 2^64."""
    base = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[which]
    values = np.random.default_rng(which + 1).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    inverse = pow(base, -1, 2**64)
    filled = 1
    while filled < size:
        more = min(filled, size - filled)
        up[filled : filled + more] = up[:more] * np.uint64(pow(base, filled, 2**64))
        down[filled : filled + more] = down[:more] * np.uint64(pow(inverse, filled, 2**64))
        filled += more
    return values, up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    values, up, _ = _powers(which, 1 << PLACE)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def _digests(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, which: int) -> np.ndarray:
    return (sums[end] - sums[start]) * _powers(which, 1 << PLACE)[2][start]


def sampled(data: np.ndarray, length: int, context: int) -> tuple[np.ndarray, ...]:
    """Of one piece of text: first window, place of the suffix, last window, order key, region digest."""
    n, wide = len(data), length - context + 1
    first = _sums(data, 0)
    grams = _digests(first, slice(0, n - context + 1), slice(context, n + 1), 0)
    order = _mix(grams)
    low = (order & np.uint64(2**64 - 2**PLACE)) | np.arange(len(order), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    place = (low & np.uint64(2**PLACE - 1)).astype(np.int64)
    turns = np.flatnonzero(place[1:] != place[:-1]) + 1
    start = np.concatenate([[0], turns])
    last = np.concatenate([turns - 1, [len(place) - 1]])
    place = place[start]
    region = _mix(_digests(_sums(data, 1), start, last + length, 1))
    region ^= _mix(((place - start) * 4096 + (last - start) + 1).astype(np.uint64))
    return start, place, last, order[place], region


def _suffixes(length: int, context: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = (1 << PLACE) - length
        for batch in pieces(batches):
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, text in enumerate(batch.column("text")):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for at in range(0, max(0, len(data) - length + 1), step):
                    start, place, last, key, region = sampled(data[at : at + step + length - 1], length, context)
                    for column, x in zip(found, (np.full(len(start), row), key, region, start + at, place - start, last - start)):
                        column.append(x)
            if found[0]:
                rows, key, region, start, lead, span = (np.concatenate(x) for x in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").take(pa.array(rows)),
                        pa.array(key.view(np.int64)),
                        pa.array(region.view(np.int64)),
                        *(pa.array(x.astype(np.int32)) for x in (start, lead, span)),
                    ],
                    names=["rid", "key", "region", "start", "lead", "span"],
                )

    return of


def _with_rid(docs: DataFrame, key: str) -> DataFrame:
    """Rows are known by a hash of id and text; equal rows share it and are copies of each other."""
    return docs.select(row_hash(key).alias("rid"), F.col(key), F.col("text"))


def index_run(suffixes: DataFrame) -> DataFrame:
    """The distinct suffixes of a batch in order, with their number."""
    return suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key")


def add_batch(levels: dict[int, DataFrame], suffixes: DataFrame) -> DataFrame:
    """Scan a batch against all levels, then put it into the family; gives the matched keys.

    ``levels`` maps a level to its run, of 2^level batches, and is changed in place.
    """
    run = cut_lineage(index_run(suffixes))
    matched = run.where("n > 1").select("key")
    for level in levels.values():
        matched = matched.union(run.join(level.select("key"), "key", "left_semi").select("key"))
    matched = cut_lineage(matched.distinct())
    level = 0
    while level in levels:
        both = levels.pop(level).union(run)
        run = cut_lineage(both.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"))
        level += 1
    levels[level] = run
    return matched


def _regions(length: int):
    """Cut the regions of a text's suffixes out of it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text, places in zip(batch.column("text"), batch.column("places")):
                data, rows = (text.as_py() or "").encode(), places.as_py()
                yield pa.RecordBatch.from_pylist(
                    [x | {"bytes": data[x["start"] : x["start"] + x["span"] + length]} for x in rows],
                    schema=_REGION_SCHEMA,
                )

    return of


_REGION = "key long, region long, n long, regions long, rid long, start int, lead int, span int"
_REGION_SCHEMA = pa.schema(
    [(x.split()[0], {"long": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in _REGION.split(", ")] + [("bytes", pa.binary())]
)


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    other = a != b
    at = other.argmax(axis=1)
    return np.where(other[np.arange(len(at)), at], at, a.shape[1])


def repeated_windows(rows: dict[str, np.ndarray], regions: list[bytes], length: int, context: int) -> np.ndarray:
    """For each region (sorted by key) and window: is it in another region of the same key?"""
    n, ahead = len(regions), length - context
    lead = rows["lead"].astype(np.int64)
    left = np.frombuffer(b"".join(r[:k][::-1].ljust(ahead, b"\0") for r, k in zip(regions, lead.tolist())), np.uint8)
    right = np.frombuffer(b"".join(r[k:].ljust(length, b"\0") for r, k in zip(regions, lead.tolist())), np.uint8)
    left, right = left.reshape(n, ahead), right.reshape(n, length)
    tail = np.array([len(r) for r in regions], np.int64) - lead
    marks = np.zeros((n, ahead + 2), np.int32)
    open_, step = np.arange(n), 1
    while len(open_ := open_[open_ + step < n]):
        open_ = open_[rows["key"][open_] == rows["key"][open_ + step]]
        for at in range(0, len(open_), 4096):
            i = open_[at : at + 4096]
            j = i + step
            other = (rows["rid"][i] != rows["rid"][j]) | (rows["start"][i] + lead[i] != rows["start"][j] + lead[j])
            i, j = i[other], j[other]
            before = np.minimum(_first_difference(left[i], left[j]), np.minimum(lead[i], lead[j]))
            after = np.minimum(_first_difference(right[i], right[j]), np.minimum(tail[i], tail[j]))
            # Windows are told by how far before the suffix they start.
            hit = before + after >= length
            for x in (i[hit], j[hit]):
                np.add.at(marks, (x, length - after[hit]), 1)
                np.add.at(marks, (x, before[hit] + 1), -1)
        step += 1
    return np.cumsum(marks, axis=1)[:, : ahead + 1] > 0


def counted_windows(rows: dict[str, np.ndarray], regions: list[bytes], length: int, context: int) -> np.ndarray:
    """The same as ``repeated_windows`` for the regions of one key, by the digests of the windows."""
    digests: list[list[np.ndarray]] = [[], []]
    sizes = np.array([len(r) - length + 1 for r in regions])
    for data in regions:
        data = np.frombuffer(data, np.uint8)
        for which, column in enumerate(digests):
            sums = _sums(data, which)
            column.append(_digests(sums, slice(0, len(data) - length + 1), slice(length, len(data) + 1), which))
    a, b = (np.concatenate(x) for x in digests)
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    again = np.zeros(len(a), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    row = np.repeat(np.arange(len(regions)), sizes)
    window = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    marked = np.zeros((len(regions), length - context + 1), bool)
    marked[row[again], rows["lead"].astype(np.int64)[row[again]] - window[again]] = True
    return marked


def _spans_of(rows: dict[str, np.ndarray], marked: np.ndarray, length: int) -> pa.RecordBatch:
    """Marked windows as byte spans (rid, first, past)."""
    edges = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, nearest = np.nonzero(edges == 1)
    farthest = np.nonzero(edges == -1)[1] - 1
    suffix = (rows["start"] + rows["lead"])[row]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["rid"][row]), pa.array((suffix - farthest).astype(np.int32)), pa.array((suffix - nearest + length).astype(np.int32))],
        names=["rid", "first", "past"],
    )


def _compare(length: int, context: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def spans(part: pa.Table) -> pa.RecordBatch:
            rows = {k: part.column(k).to_numpy() for k in ("key", "rid", "start", "lead", "span", "n", "regions")}
            regions = part.column("bytes").to_pylist()
            marked = np.zeros((len(regions), length - context + 1), bool)

            def mark(at: np.ndarray, by) -> None:
                if len(at):
                    marked[at] = by({k: x[at] for k, x in rows.items()}, [regions[i] for i in at.tolist()], length, context)

            few = rows["regions"] <= PAIRED
            mark(np.flatnonzero(few), repeated_windows)
            for key in np.unique(rows["key"][~few]):
                mark(np.flatnonzero(rows["key"] == key), counted_windows)
            marked[rows["n"] > 1] = False
            return _spans_of(rows, marked, length)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            keys = rest.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield spans(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield spans(rest)

    return of


def _windows(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rid, start, data in zip(*(batch.column(k) for k in ("n", "rid", "start", "bytes"))):
                data = np.frombuffer(data.as_py(), np.uint8)
                count = len(data) - length + 1
                a, b = (
                    _mix(_digests(_sums(data, k), slice(0, count), slice(length, len(data) + 1), k)).view(np.int64)
                    for k in (0, 1)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a),
                        pa.array(b),
                        pa.array(np.full(count, rid.as_py(), np.int64)),
                        pa.array(np.full(count, start.as_py(), np.int32) + np.arange(count, dtype=np.int32)),
                        pa.array(np.full(count, n.as_py() > 1)),
                    ],
                    names=["a", "b", "rid", "first", "whole"],
                )

    return of


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    context: int = CONTEXT,
    batches: int = BATCHES,
    key: str = "doc_id",
    hot_regions: int = HOT_REGIONS,
) -> DataFrame:
    """(rid, first, past): byte spans that strings of ``length`` repeated bytes cover; they may overlap."""
    marked = _with_rid(docs, key)
    suffixes = marked.select("rid", "text").mapInArrow(
        _suffixes(length, context), "rid long, key long, region long, start int, lead int, span int"
    )
    suffixes = cut_lineage(suffixes.withColumn("batch", F.pmod(F.xxhash64(F.lit(11), "rid"), F.lit(batches))))
    levels: dict[int, DataFrame] = {}
    matched = [add_batch(levels, suffixes.where(F.col("batch") == i)) for i in range(batches)]
    keys = matched[0]
    for more in matched[1:]:
        keys = keys.union(more)
    # Also the earlier partner of a match: the semi join reaches it by its key.
    # The keys are a table of their own, so that a hot key can be split in this join.
    hits = cut_lineage(suffixes.drop("batch").join(cut_lineage(keys.distinct()), "key", "left_semi"))
    classes = hits.groupBy("key", "region").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "start", "lead", "span")).alias("at")
    )
    classes = cut_lineage(classes)
    whole = hits.join(classes.where("n > 1").select("key", "region"), ["key", "region"]).select(
        "rid", F.col("start").alias("first"), (F.col("start") + F.col("span") + length).alias("past")
    )
    several = classes.groupBy("key").agg(F.count("*").alias("regions")).where("regions > 1")
    partly = classes.join(several, "key").select("key", "region", "n", "regions", "at.*")
    places = partly.groupBy("rid").agg(
        F.collect_list(F.struct("key", "region", "n", "regions", "rid", "start", "lead", "span")).alias("places")
    )
    # Equal rows share rid and text: one of them is enough.
    texts = marked.select("rid", "text").join(places, "rid").select("rid", "places", "text")
    cut = texts.select("places", "text").mapInArrow(_regions(length), f"{_REGION}, bytes binary")
    cut = cut_lineage(cut.dropDuplicates(["rid", "start", "key"]))
    compared = (
        cut.where(F.col("regions") <= hot_regions)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_compare(length, context), "rid long, first int, past int")
    )
    windows = cut.where(F.col("regions") > hot_regions).mapInArrow(
        _windows(length), "a long, b long, rid long, first int, whole boolean"
    )
    again = windows.groupBy("a", "b").count().where("count > 1").select("a", "b")
    counted = windows.where("not whole").join(again, ["a", "b"]).select(
        "rid", "first", (F.col("first") + length).alias("past")
    )
    return whole.union(compared).union(counted)


def _cut_out(key: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data, removed, runs, end, kept = (text.as_py() or "").encode(), 0, 0, -1, []
                at = 0
                for span in sorted((x["first"], x["past"]) for x in spans.as_py() or []):
                    if span[0] > end:
                        kept.append(data[at : span[0]])
                        runs += 1
                        at = end = span[0]
                    if span[1] > end:
                        removed += span[1] - end
                        at = end = span[1]
                kept.append(data[at:])
                rows.append((len(data), removed, runs, b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return of


def remove_repeats(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, batches: int = BATCHES, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary): each text without bytes that repeated strings cover.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in the same text or
    another; strings are judged on the input. Null counts as empty, texts below ``length`` stay whole,
    equal rows are copies of each other, and null ids are texts like any other.
    """
    spans = repeated_spans(docs, length, context, batches, key)
    by_row = spans.groupBy("rid").agg(F.collect_set(F.struct("first", "past")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    joined = _with_rid(docs, key).join(by_row, "rid", "left").select(F.col(key).alias("id"), "text", "spans")
    return joined.mapInArrow(_cut_out(key), f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

