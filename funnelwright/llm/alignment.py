"""Tokens of two tokenizers aligned by the bytes they cover, by skipping runs on a diagonal.

Both tokenizers encode the same bytes; a token is known by where it ends. ``align`` compares the two
lists of ends at the current index shift (the diagonal): a probe of 1, 2, 4, ... tokens jumps over
stretches where both cut alike, a halving of the last probe finds the first difference. There an
irregular group is resolved step by step until both end together, and the shift moves by the
difference of its lengths. A group's tokens are linked where their bytes overlap.

``encoded`` gives each row's groups and its distinct linked pairs with their counts; ``counts`` sums
them over the corpus. ``linked`` brings the sums back: the commonest pairs, at most COMMON, go to the
tasks; the occurrences of rarer pairs meet their counts in a join.

A byte-level tokenizer (A) gets a space and the text, a piece tokenizer (B) the text, to which it adds
the space. Null and empty texts, and those whose tokens don't give back the bytes, have no tokens. Long
texts are encoded in strips, cut at single spaces between ASCII letters: there both tokenizers begin a
token whatever stands around, as no token goes on after a space that follows a letter.

For the same reason, at single spaces between other characters than white space, the groups of a strip
are those of its words. The words that a task has not seen lately are joined into a strip of their own,
encoded and aligned as such, and remembered with their groups and links; the others come from memory.

Ids must be below 2^16 and 2^15, so that a pair is one int.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, least_count, pieces

TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a strip, about; pairs whose counts every task holds, at most (13 bytes each).
STRIP, COMMON = 1 << 16, 1 << 20
#: Characters whose new words a task encodes at a time, about.
AT_ONCE = 1 << 20
B_BITS = 15
#: Words that a task remembers at most, and how long they may be.
REMEMBERED, LONGEST = 1 << 18, 64

#: Fixed value: how a byte-level tokenizer of this kind cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these letters, two libraries may know different versions of Unicode.
_LATER = re.compile("[^\x00-\u024f]")
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: A space between words, and one that may not be a cut: with white space on one side only it is, but not on both.
#: Python's white space takes in all that the pattern's does.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_UNSURE = re.compile(r" \s")

#: A stretch of text with its groups written out and the pairs of its links (int32): tokens a, tokens b, groups, both texts.
Aligned = tuple[int, int, int, str, bytes]
#: A stretch whose tokens don't give back its bytes.
NONE: Aligned = (0, 0, 0, "", b"")


def align(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Groups of two lists of ends with the same last end, in order: (from a, to a, from b, to b).

    A stretch that is cut alike comes as one item, with as many tokens on both sides.
    """
    a = b = 0
    while a < len(ends_a):
        start, width = a, 1
        # The diagonal: probes grow while they agree, then shrink around the first difference.
        while width and a < len(ends_a):
            if ends_a[a : a + width] == ends_b[b : b + width]:
                a, b, width = a + width, b + width, width * 2
            else:
                width //= 2
                while width:
                    if ends_a[a : a + width] == ends_b[b : b + width]:
                        a, b = a + width, b + width
                    width //= 2
        a, b = min(a, len(ends_a)), min(b, len(ends_b))
        if a > start:
            yield start, a, b - (a - start), b
        if a < len(ends_a):
            first_a, first_b = a, b
            end_a, end_b = ends_a[a], ends_b[b]
            while end_a != end_b:
                if end_a < end_b:
                    a += 1
                    end_a = ends_a[a]
                else:
                    b += 1
                    end_b = ends_b[b]
            a, b = a + 1, b + 1
            yield first_a, a, first_b, b


def _byte_values() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for.

    Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, and what their ids stand for."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        values, vocabulary = _byte_values(), self.a.get_vocab(with_added_tokens=True)
        described = json.loads(Path(byte_file).read_text())
        special = {t["content"] for t in described["added_tokens"]}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.bytes_a[at] = token.encode() if token in special else bytes(values[c] for c in token)
        # If ids follow the order of the merges, the vocabulary is its own ranks, for a faster encoder.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in described["model"]["merges"]]
        places = [vocabulary[m] for m in merged]
        self.fast = None
        if places == sorted(places) and described["pre_tokenizer"].get("use_regex") and not described["normalizer"]:
            ranks = {self.bytes_a[at]: at for token, at in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = []
        for at in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(at)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(at) else piece.replace("▁", " ").encode())
        # True where no piece holds a space after another character.
        self.by_word = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        # Where the pattern is known too, both begin a token at each space between words.
        self.by_words = self.by_word and self.fast is not None and all(t["special"] for t in described["added_tokens"])
        self.seen: dict[str, list[int]] = {}
        # Words met since the last change, and those of the time before.
        self.words: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.name_a, self.name_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(len(self.bytes_b))))

    def encode_a(self, text: str) -> list[int]:
        if self.fast and not _LATER.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int] | None:
        """Ids of a text by the piece tokenizer, which adds a space; None if they don't give back the bytes.

        A piece never goes on after a space that follows another character, so words between single
        spaces are encoded apart, and remembered.
        """
        parts = text.split(" ") if self.by_word else [text]
        if "" in parts:
            parts = [text]
        ids: list[int] = []
        for part in parts:
            known = self.seen.get(part)
            if known is None:
                known = self.b.encode(part)
                if b"".join(map(self.bytes_b.__getitem__, known)) != (" " + part).encode():
                    return None
                if len(part) <= LONGEST:
                    if len(self.seen) >= REMEMBERED // 4:
                        self.seen.clear()
                    self.seen[part] = known
            ids += known
        return ids

    def encode(self, strip: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a strip; None where one doesn't give back its bytes."""
        a, b = self.encode_a(" " + strip), self.encode_b(strip)
        same = b is not None and b"".join(map(self.bytes_a.__getitem__, a)) == (" " + strip).encode()
        return (a, b) if same else None

    def aligned(self, a: list[int], b: list[int], cuts: list[int]) -> list[Aligned]:
        """The groups and links of both ids of a strip, for each part; parts end at the bytes ``cuts``, where groups do."""
        ids_a, ids_b = np.array(a, np.int32), np.array(b, np.int32)
        after_a, after_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        ends_a, ends_b = after_a.tolist(), after_b.tolist()
        names_a, names_b = list(map(self.name_a.__getitem__, a)), list(map(self.name_b.__getitem__, b))
        written, group_ends = [], []
        for from_a, to_a, from_b, to_b in align(ends_a, ends_b):
            if ends_a[from_a] == ends_b[from_b]:
                written += map("|".join, zip(names_a[from_a:to_a], names_b[from_b:to_b]))
                group_ends += ends_a[from_a:to_a]
            else:
                written.append(",".join(names_a[from_a:to_a]) + "|" + ",".join(names_b[from_b:to_b]))
                group_ends.append(ends_a[to_a - 1])
        # Between two neighbouring ends, of whichever side, lies one token of each: a link.
        is_end = np.zeros(ends_a[-1] + 1, bool)
        is_end[after_a] = is_end[after_b] = True
        link_ends = np.flatnonzero(is_end)
        pairs = ((ids_a[after_a.searchsorted(link_ends)] << B_BITS) | ids_b[after_b.searchsorted(link_ends)]).tobytes()
        if len(cuts) == 1:
            return [(len(a), len(b), len(written), ";".join(written), pairs)]
        upto_a, upto_b, upto_group, upto_link = (
            np.searchsorted(ends, cuts, "right").tolist() for ends in (after_a, after_b, group_ends, link_ends)
        )
        out, a0, b0, group0, link0 = [], 0, 0, 0, 0
        for a1, b1, group1, link1 in zip(upto_a, upto_b, upto_group, upto_link):
            out.append((a1 - a0, b1 - b0, group1 - group0, ";".join(written[group0:group1]), pairs[4 * link0 : 4 * link1]))
            a0, b0, group0, link0 = a1, b1, group1, link1
        return out

    def alone(self, strip: str) -> Aligned:
        """The groups and links of a strip; NONE if it is empty or its bytes are not given back."""
        ids = self.encode(strip) if strip else None
        return self.aligned(*ids, [len(strip.encode()) + 1])[0] if ids else NONE

    def together(self, parts: list[str]) -> Iterator[tuple[str, Aligned]]:
        """Each of some words with its groups and links; all are encoded and aligned as one strip."""
        held, b, cuts, end = [], [], [], 0
        for part, ids in zip(parts, self.b.encode(parts, num_threads=1)):
            data = (" " + part).encode()
            if b"".join(map(self.bytes_b.__getitem__, ids)) == data:
                end += len(data)
                held.append(part)
                cuts.append(end)
                b += ids
            else:
                yield part, NONE
        if held:
            strip = " " + " ".join(held)
            a = self.encode_a(strip)
            same = b"".join(map(self.bytes_a.__getitem__, a)) == strip.encode()
            yield from zip(held, self.aligned(a, b, cuts) if same else map(self.alone, held))

    def resolved(self, some: list[str]) -> Iterator[Aligned]:
        """The groups and links of strips, by words where they can be cut into such; NONE if a word has none."""
        if not self.by_words:
            yield from map(self.alone, some)
            return
        # A space at an end of a strip is none between words.
        cut = [_BETWEEN.split(s) if s.startswith(" ") or s.endswith(" ") or _UNSURE.search(s) else s.split(" ") for s in some]
        new: dict[bool, list[str]] = {False: [], True: []}
        apart: dict[str, Aligned] = {}
        for part in set(chain.from_iterable(cut)).difference(self.words):
            known = self.older.get(part)
            if known is not None:
                self.words[part] = known
            elif not 0 < len(part) <= LONGEST or part[0].isspace() or part[-1].isspace():
                apart[part] = self.alone(part)
            else:
                new[not part.isascii() and bool(_LATER.search(part))].append(part)
        for parts in new.values():
            self.words.update(self.together(parts))
        for parts in cut:
            found = list(map(self.words.get, parts))
            if apart:
                found = [apart[part] if x is None else x for x, part in zip(found, parts)]
            n_a, n_b, groups, written, pairs = zip(*found)
            yield (sum(n_a), sum(n_b), sum(groups), ";".join(written), b"".join(pairs)) if 0 not in n_a else NONE
        if len(self.words) >= REMEMBERED // 2:
            self.older, self.words = self.words, {}

    def links(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(tokens a, tokens b, groups, digest of the groups, pairs of all links) of each text."""

        def by_strips() -> Iterator[tuple[int, Aligned]]:
            rows, held, size = [], [], 0
            for row, text in enumerate(texts):
                for strip in strips(text or ""):
                    rows.append(row)
                    held.append(strip)
                    size += len(strip)
                    if size >= AT_ONCE:
                        yield from zip(rows, self.resolved(held))
                        rows, held, size = [], [], 0
            yield from zip(rows, self.resolved(held))

        for _, some in groupby(by_strips(), itemgetter(0)):
            n_a = n_b = groups = 0
            digest, between, pairs, whole = hashlib.sha256(), "", [], True
            for _, (more_a, more_b, more, written, linked) in some:
                n_a, n_b, groups, whole = n_a + more_a, n_b + more_b, groups + more, whole and more_a > 0
                digest.update((between + written).encode())
                pairs.append(linked)
                between = ";"
            if whole:
                yield n_a, n_b, groups, digest.hexdigest(), np.frombuffer(b"".join(pairs), np.int32)
            else:
                yield 0, 0, 0, "", np.empty(0, np.int32)


def strips(text: str) -> Iterator[str]:
    """A text in strips, the space between two of them left out."""
    start = 0
    while len(text) - start > STRIP:
        cut = _CUT.search(text, start + STRIP)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def encoded(docs: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<int>, times array<int>) for every row.

    ``pairs`` are the distinct linked pairs, ``a * 2^15 + b``, and ``times`` how often each is linked.
    ``folder`` holds the vocabulary files; they travel to the executors.
    """
    spark = docs.sparkSession
    for name in (BYTE_FILE, PIECE_FILE):
        spark.sparkContext.addFile(f"{folder}/{name}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(SparkFiles.get(BYTE_FILE), SparkFiles.get(PIECE_FILE))
        for batch in pieces(batches):
            rows, pairs, times = [], [], []
            for *row, keys in tokens.links(text.as_py() for text in batch.column("text")):
                own, n = np.unique(keys, return_counts=True)
                rows.append((*row, len(keys)))
                pairs.append(own)
                times.append(n.astype(np.int32))
            n_a, n_b, groups, digests, links = zip(*rows)
            longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *longs, pa.array(digests), pa.array(pairs, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=[key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("id"), "text").mapInArrow(
        of, f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    )
    # Written once: the texts are encoded once, and the row numbers stay.
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


def counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) for every linked pair: its links in the corpus, and whether no pair of its B id has more."""
    pairs = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    summed = cut_lineage(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    id_b = F.col("pair") % (1 << B_BITS)
    most = summed.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("most"))
    return summed.withColumn("id_b", id_b).join(most, "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(docs: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (key, text)."""
    rows = encoded(docs, key, folder)
    known = cut_lineage(counts(rows))
    least = least_count(known, COMMON)
    common = known.where(F.col("n") >= least).toArrow().sort_by("pair")
    pair, n, best = (common.column(c).to_numpy() for c in ("pair", "n", "best"))
    held = docs.sparkSession.sparkContext.broadcast((pair, n, best))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            sums, bests, rare, rare_times = [], [], [], []
            for own, times in zip(batch.column("pairs"), batch.column("times")):
                own, times = own.values.to_numpy(), times.values.to_numpy().astype(np.int64)
                at = np.searchsorted(pair, own)
                hit = np.flatnonzero(at < len(pair))
                hit = hit[pair[at[hit]] == own[hit]]
                at = at[hit]
                sums.append(int((times[hit] * n[at]).sum()))
                bests.append(int(times[hit][best[at]].sum()))
                left = np.ones(len(own), bool)
                left[hit] = False
                rare.append(own[left])
                rare_times.append(times[left].astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), pa.array(rare, ints), pa.array(rare_times, ints)],
                names=["row", "count_sum", "n_best", "pairs", "times"],
            )

    met = rows.select("row", "pairs", "times").mapInArrow(of, "row long, count_sum long, n_best long, pairs array<int>, times array<int>")
    if least > 1:
        met = cut_lineage(met)
        rest = met.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        rest = rest.select("row", F.col("x.pairs").alias("pair"), "x.times").join(known.where(F.col("n") < least), "pair")
        rest = rest.select("row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
        met = met.select("row", "count_sum", "n_best").union(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.join(met, "row").select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

