"""Exact top k by integer inner product: exhaustive term-at-a-time accumulation over blocks.

A vector is a sparse row: component t with weight w is a posting of term t. Rows are packed into
blocks; every block of queries meets every block of candidates in some task. There, for each term,
the weights of the queries that have it are scattered over its postings into one dense array of
scores per query; a partition selects the k best of each array, and a window merges the blocks'
selections. Every score is computed, so the result is exact; the work is queries times rows, and a
task holds two blocks and their scores only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage

#: Rows in a block of candidates, and of queries.
ROWS, QUERIES = 4096, 512
LONG = 2**63 - 1


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, weights array<long>) with floor(scale * x) for each component, in double.

    Rows without an id or vector, and vectors with a null or non-finite component, are left out.
    Weights beyond 64 bits become the nearest long.
    """
    x = F.col(vector)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & usable).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("weights"),
    )


def _pack(rows: int):
    """Blocks: ids, row of each non-zero weight, its term, and the weights, as bytes."""

    def block(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> list[bytes]:
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        used = weights != 0
        return [x.tobytes() for x in (ids, row[used], term[used].astype(np.int32), weights[used])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("weights")
                packed = block(
                    part.column("vec_id").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["ids", "row", "term", "weight"])

    return of


def _pack_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries: consecutive rows of one part."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                for block in _pack(QUERIES)(iter([batch.slice(start, end - start)])):
                    number = pa.array([part[start]] * block.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([number, *block.columns], names=["part", *block.schema.names])


def accumulate(queries: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...]) -> np.ndarray:
    """Scores (queries, rows) term at a time; Python integers where 64 bits might not do."""
    q_ids, q_row, q_term, q_weight = queries
    ids, row, term, weight = block
    bound = 0.0
    if len(q_weight) and len(weight):
        bound = float(np.abs(q_weight.astype(float)).max()) * float(np.abs(weight.astype(float)).max()) * (1.0 + int(term.max()))
    kind = np.int64 if bound < 2.0**62 else object
    scores = np.zeros((len(q_ids), len(ids)), kind)
    by_term, q_by_term = np.argsort(term, kind="stable"), np.argsort(q_term, kind="stable")
    terms, starts = np.unique(term[by_term], return_index=True)
    ends = [*starts[1:].tolist(), len(term)]
    for t, start, end in zip(terms.tolist(), starts.tolist(), ends):
        low, high = np.searchsorted(q_term[q_by_term], [t, t + 1])
        own, postings = q_by_term[low:high], by_term[start:end]
        if len(own):
            add = np.multiply.outer(q_weight[own].astype(kind), weight[postings].astype(kind))
            if len(own) == len(q_ids) and len(postings) == len(ids):
                scores += add[np.argsort(q_row[own])][:, np.argsort(row[postings])]
            else:
                scores[np.ix_(q_row[own], row[postings])] += add
    return scores if kind is np.int64 else np.clip(scores, -LONG - 1, LONG).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[int]:
    """Places of the k best scores but for the own id, ties to smaller ids: select, then sort few."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        s = scores[places]
        places = places[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return sorted(places.tolist(), key=lambda j: (-int(scores[j]), int(ids[j])))[:k]


def _search(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ids": np.int64, "row": np.int32, "term": np.int32, "weight": np.int64}
        for batch in batches:
            for i in range(batch.num_rows):
                queries, block = (
                    tuple(np.frombuffer(batch.column(f"{side}{name}")[i].as_py(), kind) for name, kind in kinds.items())
                    for side in ("q_", "")
                )
                scores = accumulate(queries, block)
                out = [
                    (own, int(block[0][j]), int(scores[q, j]))
                    for q, own in enumerate(queries[0].tolist())
                    for j in best_of(scores[q], block[0], own, k)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"]
                )

    return of


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query (all, if fewer), ties to smaller ids.

    Both inputs as from ``scaled``; rows with the query's own id are no candidates. Vectors of
    unlike lengths are compared over the terms that both have. A repeated id is asked once, and a
    candidate for each of its rows. Empty inputs give no rows.
    """
    names = ["ids", "row", "term", "weight"]
    schema = ", ".join(f"{x} binary" for x in names)
    once = queries.dropDuplicates(["vec_id"])
    groups = max(1, -(-once.count() // QUERIES))
    # A group holds about QUERIES rows; packing cuts larger ones.
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    asked = (
        once.groupBy(group.alias("part")).agg(F.collect_list(F.struct("vec_id", "weights")).alias("rows"))
        .select("part", F.inline("rows"))
        .mapInArrow(_pack_parts, f"part int, {schema}")
        .select("part", *(F.col(x).alias(f"q_{x}") for x in names))
    )
    blocks = cut_lineage(vectors.mapInArrow(_pack(ROWS), schema))
    everywhere = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = everywhere.join(asked, "part").repartition(F.xxhash64("ids", "q_ids"))
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
