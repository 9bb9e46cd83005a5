"""What several operators share: tables, folds, words, and connected components of a link table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.sources.tables import cut_lineage, shared_folder

__all__ = ["connected_components", "crc_fold", "cut_lineage", "fresh", "least_count", "pieces", "remembered", "row_hash", "shared_path", "table", "words"]

#: A task works on texts of about so many bytes at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


class _Memory(dict):
    """Results that stay where they were made: a copy sent to a task starts empty."""

    def __reduce__(self):
        return _Memory, ()


def remembered(make: Callable) -> Callable:
    """``make`` with its results kept per argument list, as a function that can travel to tasks.

    ``functools.cache`` makes an object that is sent by name, which executors without this package
    can't look up.
    """
    memory = _Memory()

    @wraps(make)
    def kept(*arguments):
        if arguments not in memory:
            memory[arguments] = make(*arguments)
        return memory[arguments]

    kept.cache_clear = memory.clear
    return kept


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores if a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(key: str, text: str = "text") -> Column:
    """A hash of id and text: tells rows apart where ids may be null or repeated; equal rows share it."""
    return F.xxhash64(F.col(key), F.lit(7), F.col(text))


def least_count(counted: DataFrame, most: int, column: str = "n") -> int:
    """The smallest count that no more than ``most`` rows of ``counted`` have or pass (1 if all may stay).

    Rows of equal count stay or go together, so nothing has to be sorted: first the power of two is
    found in which the limit falls, then the counts within it are tallied.
    """
    power = F.floor(F.log2(column)).cast("int")
    above = 0
    for step in sorted(counted.groupBy(power.alias("power")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.power):
        if above + step.rows > most:
            inside = counted.where(power == step.power).groupBy(F.col(column).alias("n")).agg(F.count("*").alias("rows"))
            least = 2 ** (step.power + 1)
            for row in sorted(inside.collect(), key=lambda r: -r.n):
                above += row.rows
                if above > most:
                    break
                least = row.n
            return least
        above += step.rows
    return 1


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just this rule.
    """
    return text.encode().lower().split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes in each stay near CHUNK_BYTES (one row at least)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths.astype(np.int64)) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b reduced to one link from each node to the smallest node that it reaches."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links as its forest."""
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long), root the smallest node it reaches.

    Alternating large-star and small-star rounds: each shuffles the links once or twice by key
    with partial minima before, halves the depth of the trees about, and is written to the shared
    folder, so no lineage grows and nothing but two sums a round reaches the driver. Links with a
    null end, and from a node to itself, are ignored.
    """
    schema = "a long, b long"
    edges = links.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = cut_lineage(edges.mapInArrow(_forest_of, schema).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest one.
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        edges = edges.where("a != b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
