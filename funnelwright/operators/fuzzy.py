"""Pairs of similar texts without a look at every pair.

The similarity of two texts is at most twice the length of the shorter one over both lengths, so a
query only meets texts of at most four times, and at least a quarter of, its length: texts and
queries are dealt to classes of length (powers of two), and classes to blocks by a hash. A block of
queries and one of texts are arrays in a row; two bounds are computed for the whole block at once,
first from the letters that both have, then from the longest common subsequence (one machine word
for each query, a step for each character of the texts). The ratio itself is computed for the pairs
that are left.

A character that no query has matches nothing, whichever it is: within a block, queries go together
by the digits they hold, and texts that differ in other characters only are one text to them. Thousands
of codes are then a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelwright.functions.similarity import LETTERS, SCORE_THRESHOLD, SIMILARITY_WEIGHT, WORD_WEIGHT
from funnelwright.sources.tables import cut_lineage

#: Queries and texts of a block, about.
QUERY_BLOCK, TEXT_BLOCK = 512, 8192
#: Texts that meet the queries of a block together.
TOGETHER = 1024
#: Rows that a task hands on at a time.
ROWS = 1 << 16
#: How many classes up or down a text of four times or a quarter of the length can be.
REACH = 2
#: Longest query whose common subsequence fits in a machine word.
WORD_BITS = 64
DIGITS = frozenset("0123456789")
#: Pairs of a block that go through the second bound together.
STEP = 1 << 15


def _length_class(text: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def _packed(values: DataFrame, column: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    """Blocks of about ``size`` distinct texts of one length class: (class, block, texts)."""
    kind, block, texts = names
    classed = values.select(F.col(column).alias("value"), _length_class(F.col(column)).alias(kind))
    # At most some thirty classes: a length is below 2^31.
    counts = classed.groupBy(kind).count().collect()
    blocks = F.lit(1)
    for row in counts:
        blocks = F.when(F.col(kind) == row[kind], -(-row["count"] // size)).otherwise(blocks)
    dealt = classed.withColumn(block, F.pmod(F.xxhash64("value"), blocks))
    return dealt.groupBy(kind, block).agg(F.sort_array(F.collect_list("value")).alias(texts))


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, number of each letter, and codes padded to the longest text.

    A code is a place in LETTERS; all other characters share one, and one more is padding.
    """
    table = np.full(128, len(LETTERS), np.uint8)
    table[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    flat = np.where(points < 128, table[np.minimum(points, 127)], len(LETTERS)).astype(np.uint8)
    codes = np.full((len(texts), max(lengths.max(), 1)), len(LETTERS) + 1, np.uint8)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    row = np.repeat(np.arange(len(texts)), lengths)
    width = len(LETTERS) + 1
    counts = np.bincount(row * width + flat, minlength=len(texts) * width).reshape(len(texts), width)
    # A byte for each letter, if no text can have more of one.
    return lengths, counts.astype(np.uint8 if lengths.max() < 256 else np.int32), codes


def common_letters(q_counts: np.ndarray, t_counts: np.ndarray) -> np.ndarray:
    """Number of letters that each query has in common with each text."""
    common = np.zeros((len(q_counts), len(t_counts)), np.result_type(q_counts, t_counts))
    held, own = np.ascontiguousarray(q_counts.T), np.ascontiguousarray(t_counts.T)
    for letter in np.flatnonzero(held.any(axis=1) & own.any(axis=1)):
        common += np.minimum(held[letter][:, None], own[letter][None, :])
    return common


def common_sequence(q_codes: np.ndarray, q_lengths: np.ndarray, t_codes: np.ndarray, q_at: np.ndarray, t_at: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the pairs (q_at, t_at); queries of up to WORD_BITS."""
    masks = np.zeros((len(q_codes), len(LETTERS) + 2), np.uint64)
    for place in range(min(q_codes.shape[1], WORD_BITS)):
        inside = place < q_lengths
        masks[np.flatnonzero(inside), q_codes[inside, place]] |= np.uint64(1) << np.uint64(place)
    own, text = masks[q_at], t_codes[t_at]
    full = np.where(q_lengths >= WORD_BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(q_lengths, WORD_BITS - 1).astype(np.uint64)) - np.uint64(1))[q_at]
    open_ = full.copy()
    pairs = np.arange(len(q_at))
    for place in range(text.shape[1]):
        met = open_ & own[pairs, text[:, place]]
        open_ = (open_ + met) | (open_ - met)
    return q_lengths[q_at] - np.bitwise_count(open_ & full)


class _Others(dict):
    """A table for ``str.translate`` that makes all characters but those of ``kept`` one and the same, which is none of them."""

    def __init__(self, kept: set[str]) -> None:
        self.other = next(i for i in count() if chr(i) not in kept)
        super().__init__((ord(c), ord(c)) for c in kept)

    def __missing__(self, point: int) -> int:
        self[point] = self.other
        return self.other


def _block_pairs(queries: list[str], texts: list[str]) -> Iterator[tuple[str, str, float]]:
    """(query, text, score) of the pairs that score by similarity and aren't contained."""
    by_digits: dict[frozenset[str], list[str]] = {}
    for query in queries:
        by_digits.setdefault(frozenset(query) & DIGITS, []).append(query)
    for own in by_digits.values():
        # A space always counts: it parts words.
        table, alike = _Others(set("".join(own)) | {" "}), {}
        for text in texts:
            alike.setdefault(text.translate(table), []).append(text)
        shown = list(alike)
        for start in range(0, len(shown), TOGETHER):
            for query, text, score in _pairs(own, shown[start : start + TOGETHER]):
                for each in alike[text]:
                    yield query, each, score


def _pairs(queries: list[str], texts: list[str]) -> Iterator[tuple[str, str, float]]:
    q_lengths, q_counts, q_codes = _coded(queries)
    t_lengths, t_counts, t_codes = _coded(texts)
    both = q_lengths[:, None] + t_lengths[None, :]
    # Divided as the ratio is, so that a pair on the threshold isn't lost to rounding.
    q_all, t_all = np.nonzero(2 * common_letters(q_counts, t_counts).astype(np.int32) / both >= SCORE_THRESHOLD)
    q_words = [set(q.split(" ")) for q in queries]
    t_words = [set(t.split(" ")) for t in texts]
    order = np.argsort(t_all, kind="stable")
    q_all, t_all = q_all[order], t_all[order]
    matcher, last = SequenceMatcher(None, "", ""), None
    for start in range(0, len(q_all), STEP):
        q_at, t_at = q_all[start : start + STEP], t_all[start : start + STEP]
        length = both[q_at, t_at]
        short = q_lengths[q_at] <= WORD_BITS
        bound = np.ones(len(q_at))
        bound[short] = 2 * common_sequence(q_codes, q_lengths, t_codes, q_at[short], t_at[short]) / length[short]
        left = bound >= SCORE_THRESHOLD
        for i, j, most in zip(q_at[left].tolist(), t_at[left].tolist(), bound[left].tolist()):
            query, text = queries[i], texts[j]
            by_words = len(q_words[i] & t_words[j]) / len(q_words[i]) * WORD_WEIGHT
            # Where words score as much anyway, the ratio decides nothing; equal texts are contained.
            if (by_words >= SCORE_THRESHOLD * WORD_WEIGHT and by_words >= most * SIMILARITY_WEIGHT) or query in text:
                continue
            if j != last:
                matcher.set_seq2(text)
                last = j
            matcher.set_seq1(query)
            ratio = matcher.ratio()
            if ratio >= SCORE_THRESHOLD:
                yield query, text, max(by_words, ratio * SIMILARITY_WEIGHT)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for queries, texts in zip(batch.column("queries"), batch.column("texts")):
            pairs = _block_pairs(queries.as_py(), texts.as_py())
            while found := list(islice(pairs, ROWS)):
                q, text, score = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(text, pa.string()), pa.array(score, pa.float64())], names=["q", "text", "score"])


def block_pairs(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks that must be compared: one row for each block of queries and each of texts within reach."""
    asked = _packed(queries, "q", QUERY_BLOCK, ("q_class", "q_block", "queries"))
    held = _packed(texts, "text", TEXT_BLOCK, ("text_class", "text_block", "texts"))
    reach = F.explode(F.sequence(F.col("q_class") - REACH, F.col("q_class") + REACH))
    return asked.withColumn("text_class", reach).join(held, "text_class")


def similar_pairs(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, text, score) of queries ``q`` and texts ``text`` with a ratio of SCORE_THRESHOLD or more.

    Both tables hold distinct texts. The score is the better of the weighted ratio and the weighted
    share of words. Left out are pairs whose query is contained in the text, and those whose words
    score as much without the ratio: both are found by their words and pieces.
    """
    blocks = block_pairs(queries, texts)
    # Dealt to all tasks: pairs of blocks are few, and each is long work.
    dealt = cut_lineage(blocks.repartition("q_class", "q_block", "text_class", "text_block"))
    return dealt.select("queries", "texts").mapInArrow(_compared, "q string, text string, score double")
