"""Benchmark passages in documents: latent semantic retrieval, then checks of the words themselves.

Words are hashed to TERMS columns. Their document frequencies are counted over all documents. A randomised
SVD of the TF-IDF matrix of passages is computed from the term side: the matrix and its transpose are
applied to a random block, as one pass over the passages whose contributions are summed by term in a
shuffle, and the matrix to that block's orthonormal basis, as another; only the term block (TERMS x
RANK) reaches the driver. The latent axes are fitted on the passages of all documents, scaled to
equal spread, and every passage of every document is then searched: sliding windows of words are folded
into the latent space and compared by cosine with the benchmark's windows, which cover items all along.
A word search finds what the cosine can't: a text with PARAPHRASED of an item's words has MEET at least
of any so many of them, so the item's rarest words are looked up, and a text where MEET of them stand
within the item's length is a candidate too, for items of any length. Candidates are decided by
the longest common subsequence of words with the item, and by its answer (a column ``answer``, or
the item's last sentence), which a paraphrase must still hold.

The benchmark is read in blocks of BLOCK_BYTES by hash of the item, each searched in a pass of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, pieces, words

TERMS, RANK, OVERSAMPLE = 1 << 14, 64, 8
#: Windows have STRIDE * SPREAD words and start at every STRIDE-th word.
STRIDE, SPREAD = 8, 3
WIDE = STRIDE * SPREAD
COSINE, COPIED, PARAPHRASED, ANSWERED = 0.65, 0.8, 0.6, 0.8
BLOCK_BYTES, SEED = 2 << 20, 5
#: Rare words of an item that must stand together in a text.
MEET = 3
#: Words that a task folds at a time, and whose passages it fits together (a whole number of passages).
STRIP, FITTED = 1 << 15, WIDE << 13
#: Marks for the hashes of rare words.
MARKS = 1 << 20
#: Bytes of a word that is hashed along with others.
LONGEST = 64
#: Counts of documents times items that a task holds for the word search.
TALLIED = 1 << 20
SCHEMA = "item_id long, cosine double, lcs double, answer double, copied boolean"


def hashes_of(found: list[bytes]) -> np.ndarray:
    """Hash of each word."""
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def _crc_table() -> np.ndarray:
    """What a byte does to a crc32: the fixed rule of that checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def hashes_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``hashes_of`` the words in a text in lower case, and where they start: all words advance together, byte by byte."""
    text = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[text], prepend=True, append=True))
    start, size = edge[::2], edge[1::2] - edge[::2]
    # The longest first: those that have a further byte are a prefix. Words beyond LONGEST go one by one.
    order = np.argsort((LONGEST + 1 - np.minimum(size, LONGEST + 1)).astype(np.uint8), kind="stable")
    start, size = start[order], size[order]
    long = np.count_nonzero(size > LONGEST)
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for place in range(int(size[long:].max(initial=0))):
        end = long + int(np.searchsorted(-size[long:], -place, side="left"))
        now = crc[long:end]
        crc[long:end] = CRC[(now ^ text[start[long:end] + place]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for i in range(long):
        out[order[i]] = zlib.crc32(data[start[i] : start[i] + size[i]])
    return out, edge[::2]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in lower case, and where those of each text begin, and of a next one would."""
    data = b"\n".join(texts)
    hashes, start = hashes_in(data)
    return hashes, np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in texts)]))


def _strips_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about STRIP words."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 6 * STRIP:
            yield held
            held, size = [], 0
    if held:
        yield held


def columns_of(found: list[bytes]) -> np.ndarray:
    """Column of each word."""
    return (hashes_of(found) % TERMS).astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each text, in two bytes a word; a last row counts the texts with each term."""
    seen, texts = np.zeros(TERMS, np.int64), 0
    for batch in pieces(batches):
        coded: list[bytes] = []
        for some in _strips_of([(text.as_py() or "").encode().lower() for text in batch.column("text")]):
            hashes, begin = hashed(some)
            cols = (hashes % TERMS).astype(np.uint16)
            for at, end in zip(begin.tolist(), begin[1:].tolist()):
                own = cols[at:end]
                coded.append(own.tobytes())
                own.sort(kind="stable")
                seen[own[np.flatnonzero(np.diff(own, prepend=np.uint16(TERMS)))]] += 1
        texts += len(coded)
        none = pa.nulls(len(coded), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(coded, pa.binary()), none, none], names=["cols", "term", "n"])
    used = np.flatnonzero(seen)
    # One more term, -1, for the number of texts.
    last = [np.append(used, -1), np.append(seen[used], texts)]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in last)], names=["cols", "term", "n"])


def coded_texts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The columns of every text (cols), and log((texts + 2) / (those with the term + 1)) for each column.

    The texts are read once: both passes of ``latent_axes`` read the columns, a third of their size.
    """
    coded = cut_lineage(docs.select("text").mapInArrow(_coded, "cols binary, term array<long>, n array<long>"))
    parts = coded.where("term is not null").select(F.explode(F.arrays_zip("term", "n")).alias("x"))
    rows = dict(parts.groupBy("x.term").agg(F.sum("x.n").alias("n")).collect())
    seen = np.array([rows.get(t, 0) for t in range(TERMS)], float)
    return coded.where("cols is not null").select("cols"), np.log((rows.get(-1, 0) + 2) / (seen + 1))


def _strips(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts cut into passages of WIDE columns, filled up with TERMS, in strips; and the length of each one's TF-IDF row."""
    weights = np.append(weights, 0.0).astype(np.float32)

    def strip(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = np.concatenate(held).reshape(-1, WIDE)
        # Squared, a term counts as often in a row as it occurs there, for each of its places.
        across = np.ascontiguousarray(cols.T)
        length = np.zeros(len(cols), np.float32)
        for place in across:
            length += (across == place).sum(axis=0, dtype=np.uint8) * weights[place] ** 2
        return cols, np.maximum(np.sqrt(length), 1e-12)

    held, size = [], 0
    for batch in batches:
        for text in batch.column("cols"):
            cols = np.frombuffer(text.as_buffer(), np.uint16)
            # A long text is cut between passages.
            for at in range(0, len(cols), FITTED):
                held.append(cols[at : at + FITTED])
                size += len(held[-1])
                if len(held[-1]) % WIDE:
                    held.append(np.full(-len(held[-1]) % WIDE, TERMS, np.uint16))
                if size >= FITTED:
                    yield strip(held)
                    held, size = [], 0
    if held:
        yield strip(held)


def _image(table: np.ndarray, cols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The passages' unit TF-IDF rows times a block; ``table`` has its weighted rows, and one of zeros."""
    ones, out = np.ones(WIDE, np.float32), np.empty((len(cols), table.shape[1]), np.float32)
    for i in range(0, len(cols), STRIP // WIDE):
        part = cols[i : i + STRIP // WIDE]
        out[i : i + len(part)] = ones @ table.take(part, axis=0)
    out /= length[:, None]
    return out


def _add_by_column(total: np.ndarray, cols: np.ndarray, image: np.ndarray) -> None:
    """Adds to each column's row of ``total`` the image of every passage, once for each place of the column in it."""
    cols = cols.ravel()
    order = np.argsort(cols, kind="stable")
    ordered, row = cols[order], order // WIDE
    first = np.flatnonzero(np.diff(ordered.astype(np.int32), prepend=-1))
    many = np.diff(first, append=len(ordered))
    # The commonest column first: those that have a further place are a prefix.
    rank = np.argsort(-many, kind="stable")
    first, many = first[rank], many[rank]
    sums = np.zeros((len(first), image.shape[1]), np.float32)
    alone = int(np.searchsorted(-many, -WIDE, side="left"))
    for k in range(alone):
        for i in range(first[k], first[k] + many[k], STRIP):
            sums[k] += image.take(row[i : min(i + STRIP, first[k] + many[k])], axis=0).sum(axis=0)
    for step in range(int(many[alone:].max(initial=0))):
        end = int(np.searchsorted(-many, -step, side="left"))
        sums[alone:end] += image.take(row[first[alone:end] + step], axis=0)
    total[ordered[first]] += sums


def _weighted(weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.vstack([weights[:, None] * block, np.zeros((1, block.shape[1]))]).astype(np.float32)


def _applied(weights: np.ndarray, block: np.ndarray):
    """One pass: the passages' matrix times ``block``, and its transpose times that, by term."""
    table, width = _weighted(weights, block), block.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS + 1, width), np.float32)
        for cols, length in _strips(batches, weights):
            _add_by_column(total, cols, _image(table, cols, length) / length[:, None])
        total = total[:TERMS] * weights[:, None]
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(total[used, k].astype(np.float32)) for k in range(width))], names=["row", *(f"c{k}" for k in range(width))]
        )

    return of


def _squared(weights: np.ndarray, block: np.ndarray):
    """One pass: the passages' matrix times ``block``, its columns multiplied with one another."""
    table, width = _weighted(weights, block), block.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for cols, length in _strips(batches, weights):
            image = _image(table, cols, length)
            total += image.T @ image
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, total.T.copy())], names=["row", *(f"c{k}" for k in range(width))])

    return of


def latent_axes(coded: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (TERMS, rank) of the passages' TF-IDF matrix over its singular values.

    By randomised SVD; passages folded with these axes have the same spread along each. ``coded`` has a
    row for each text, as made by ``coded_texts``.
    """
    width = rank + OVERSAMPLE
    names = [f"c{k}" for k in range(width)]

    def summed(step, rows: int, kind: str) -> np.ndarray:
        parts = coded.mapInArrow(step, ", ".join(["row long", *(f"{c} {kind}" for c in names)]))
        found = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        total = np.zeros((rows, width))
        total[found.column("row").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in names])
        return total

    block = np.random.default_rng(SEED).standard_normal((TERMS, width))
    basis, _ = np.linalg.qr(summed(_applied(weights, block), TERMS, "float"))
    small = summed(_squared(weights, basis), width, "double")
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    squares = np.maximum(squares[::-1][:rank], 1e-9 * max(squares[-1], 1e-9))
    return basis @ turn[:, ::-1][:, :rank] / np.sqrt(squares)


@dataclass
class Items:
    """A block of the benchmark: words, answers, and the latent vectors of its windows."""

    ids: list[int]
    found: list[list[bytes]]
    answers: list[list[bytes]]
    vectors: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    #: The rare words that the word search looks up, numbered; where the places of each begin in ``places``
    #: (item, offset); and marks for their hashes.
    rare: dict[bytes, int]
    first: np.ndarray
    places: np.ndarray
    marked: np.ndarray
    #: Words of each item, and how many rare ones must meet.
    sizes: np.ndarray
    need: np.ndarray
    #: Places of each item's words, as bits.
    bits: list[dict[bytes, int]]


def answer_of(text: str, answer: str | None) -> list[bytes]:
    """Words of the answer, or of the last sentence with three words at least, or the last five."""
    if answer:
        return words(answer)
    for sentence in reversed(re.split(r"(?<=[.!?])\s+", text.strip())):
        if len(words(sentence)) >= 3:
            return words(sentence)
    return words(text)[-5:]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def needed(size: int) -> int:
    """Rare words of an item of so many words that must meet."""
    return min(MEET, math.ceil(PARAPHRASED * size - 1e-9))


def prepare(rows: list[tuple[int, str, str | None]], folded: np.ndarray, weights: np.ndarray) -> Items:
    """Items with words; each has windows all along, its last included, and its rarest words listed."""
    out = Items([], [], [], np.zeros((0, folded.shape[1]), np.float32), np.zeros(0, int), np.zeros(0, int), {}, np.zeros(1, int), np.zeros((0, 2), int), np.zeros(MARKS, bool), np.zeros(0, int), np.zeros(0, int), [])
    vectors, item, offset = [], [], []
    rare: dict[bytes, list[tuple[int, int]]] = {}
    for key, text, answer in rows:
        found = words(text)
        if not found:
            continue
        cols = columns_of(found)
        last = max(0, len(found) - WIDE)
        for at in sorted({*range(0, last, STRIDE), last}):
            vectors.append(folded[cols[at : at + WIDE]].sum(axis=0))
            item.append(len(out.ids))
            offset.append(at)
        # All but the commonest: any other choice of so many words would do.
        many = len(found) - math.ceil(PARAPHRASED * len(found) - 1e-9) + needed(len(found))
        for place in np.argsort(-weights[cols], kind="stable")[:many].tolist():
            rare.setdefault(found[place], []).append((len(out.ids), place))
        out.ids.append(key)
        out.found.append(found)
        out.bits.append(bits_of(found))
        out.answers.append(answer_of(text, answer))
    if vectors:
        out.vectors, out.item, out.offset = _unit(np.array(vectors, np.float32)), np.array(item), np.array(offset)
        out.rare = {word: i for i, word in enumerate(rare)}
        out.first = np.cumsum([0, *map(len, rare.values())])
        out.places = np.array([x for places in rare.values() for x in places])
        out.marked[hashes_of(list(rare)) % MARKS] = True
        out.sizes = np.array([len(x) for x in out.found])
        out.need = np.array([needed(x) for x in out.sizes.tolist()])
    return out


def bits_of(a: list[bytes]) -> dict[bytes, int]:
    """A bit for each place of a word."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    return places


def common_subsequence(a: list[bytes], b: list[bytes], places: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a`` (``places``, if they are known)."""
    places = bits_of(a) if places is None else places
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        if word in places and (hit := row & places[word]):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def judged(found: list[bytes], start: int, items: Items, n: int) -> tuple[float, float, bool]:
    """Share of item ``n``, and of its answer, that the text around ``start`` has in order; is it a copy?"""
    item = items.found[n]
    region = found[max(0, start - STRIDE) : max(0, start + len(item) + STRIDE)]
    share = common_subsequence(item, region, items.bits[n]) / len(item)
    answer = items.answers[n]
    answered = common_subsequence(answer, region) / len(answer) if share >= PARAPHRASED and answer else 0.0
    return share, answered, share >= COPIED or (share >= PARAPHRASED and answered >= ANSWERED)


def worded(found: list[bytes], hashes: np.ndarray, doc: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(document, item, place) wherever enough rare words of an item stand within its length.

    ``found`` are the words of some documents, ``hashes`` those of the words and ``doc`` the document of
    each, in order; only words with a rare word's mark are looked up. The place is where the item would
    start among ``found``.
    """
    spots = np.flatnonzero(items.marked[hashes % MARKS])
    word = np.fromiter(map(items.rare.get, (found[p] for p in spots.tolist()), repeat(-1)), np.int64, len(spots))
    spots, word = spots[word >= 0], word[word >= 0]
    if not len(spots):
        return []
    # Every place of each word in an item, from the list of places of all words.
    many = items.first[word + 1] - items.first[word]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.first[word], many)
    # An item is one for each document.
    place, kinds = np.repeat(spots, many), len(items.need)
    n = items.places[at, 0] + (doc[place] - doc[0]) * kinds
    start = place - items.places[at, 1]
    # Items with fewer hits than must meet go before anything is sorted.
    enough = np.bincount(n)[n] >= items.need[n % kinds]
    if not enough.any():
        return []
    n, place, start = n[enough], place[enough], start[enough]
    order = np.lexsort((start, place, n))
    n, place, start = n[order], place[order], start[order]
    once = np.ones(len(n), bool)
    once[1:] = (n[1:] != n[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1])
    n, place, start = n[once], place[once], start[once]
    # Places of an item's words, each counted once.
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (place[1:] != place[:-1])
    rank = np.cumsum(new) - 1
    item, spot = n[new], place[new]
    need, reach = items.need[item % kinds], items.sizes[item % kinds] + 2 * STRIDE
    good = np.zeros(len(item), bool)
    for k in range(1, MEET + 1):
        first = np.flatnonzero(need == k)
        first = first[first + k - 1 < len(item)]
        end = first + k - 1
        first = first[(item[end] == item[first]) & (spot[end] - spot[first] < reach[first])]
        for step in range(k):
            good[first + step] = True
    kept = good[rank]
    n, start = n[kept], start[kept]
    return list(dict.fromkeys(zip((n // kinds + doc[0]).tolist(), (n % kinds).tolist(), start.tolist())))


def _search(folded: np.ndarray, items: Items, cosine: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ones = np.vstack([folded, np.zeros((1, folded.shape[1]), np.float32)]), np.ones(STRIDE, np.float32)

        def matches(held: list[tuple[object, bytes, list[bytes]]]) -> dict[tuple[int, int], tuple[float, float, float, bool]]:
            """Best match of each document (by place) and item."""
            every, begin = hashed([data for _, data, _ in held])
            hashes = [every[i:j] for i, j in zip(begin.tolist(), begin[1:].tolist())]
            cols, first, at = [], [], 0
            for own in hashes:
                # Blocks of STRIDE words, and empty ones after the text so that windows end in it.
                size = (-(-len(own) // STRIDE) + SPREAD - 1) * STRIDE
                row = np.full(size, TERMS)
                row[: len(own)] = own % TERMS
                cols.append(row)
                first.append(at)
                at += size // STRIDE
            cols, starts, best = np.concatenate(cols), np.array(first), {}
            blocks = np.concatenate(
                [ones @ table.take(cols[i : i + STRIP], axis=0).reshape(-1, STRIDE, table.shape[1]) for i in range(0, len(cols), STRIP)]
            )
            for i in range(0, len(blocks), 4096):
                part = blocks[i : i + 4096 + SPREAD - 1]
                part = np.vstack([part, np.zeros((SPREAD - 1, part.shape[1]), np.float32)])
                count = min(4096, len(blocks) - i)
                windows = _unit(sum(part[k : k + count] for k in range(SPREAD)))
                near = windows @ items.vectors.T
                # Few windows are near any item: the others are left by their largest cosine.
                hot = np.flatnonzero(near.max(axis=1, initial=-1.0) >= cosine)
                row, vector = np.nonzero(near[hot] >= cosine)
                for w, v in zip(hot[row].tolist(), vector.tolist()):
                    doc = int(np.searchsorted(starts, i + w, side="right")) - 1
                    key = (doc, int(items.item[v]))
                    if best.get(key, (0, 0, 0, False))[1] < 1:
                        start = (i + w - first[doc]) * STRIDE - int(items.offset[v])
                        result = judged(held[doc][2], start, items, key[1])
                        if result[2] and (key not in best or result[0] > best[key][1]):
                            best[key] = (float(near[w, v]), *result)
            # Documents times items are tallied at once.
            step = max(1, TALLIED // max(1, len(items.need)))
            for some in range(0, len(held), step):
                texts = [found for _, _, found in held[some : some + step]]
                begin = np.cumsum([0, *map(len, texts)])
                doc_of = np.repeat(np.arange(some, some + len(texts)), np.diff(begin))
                for doc, n, place in worded(list(chain.from_iterable(texts)), np.concatenate(hashes[some : some + step]), doc_of, items):
                    found, start = texts[doc - some], place - int(begin[doc - some])
                    key = (doc, n)
                    if best.get(key, (0, 0, 0, False))[1] < 1:
                        result = judged(found, start, items, n)
                        if result[2] and (key not in best or result[0] > best[key][1]):
                            places = [table[columns_of(x)].sum(axis=0) for x in (found[max(0, start) :][:WIDE], items.found[n][max(0, -start) :][:WIDE])]
                            mine, other = _unit(np.array(places))
                            best[key] = (float(mine @ other), *result)
            return best

        for batch in pieces(batches):
            held, size, rows = [], 0, []

            def flush() -> None:
                rows.extend((held[doc][0], items.ids[item], *x) for (doc, item), x in sorted(matches(held).items()))

            for key, text in zip(batch.column("id"), batch.column("text")):
                data = (text.as_py() or "").encode().lower()
                found = data.split()
                if found:
                    held.append((key.as_py(), data, found))
                    size += len(found)
                if size >= STRIP:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            kinds = (batch.column("id").type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            names = ["id", "item_id", "cosine", "lcs", "answer", "copied"]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, key: str = "doc_id") -> DataFrame:
    """(key, item_id, cosine, lcs, answer, copied): documents that hold a benchmark item, and which.

    ``lcs`` is the share of the item's words that the text has in order near the window: COPIED is a
    copy; PARAPHRASED with the answer's words (ANSWERED) is a paraphrase. A pair is listed once, for
    its best window. Null and empty texts hold nothing, items without words are held by nothing;
    repeated items and rows count each. Windows without a known term match nothing.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), "text")
    coded, weights = coded_texts(source)
    axes = latent_axes(coded, weights)
    folded = (weights[:, None] * axes).astype(np.float32)
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text", answer.alias("answer"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        prepared = prepare([tuple(r) for r in mine.orderBy("item_id", "text").collect()], folded, weights)
        if not prepared.ids and found is not None:
            continue
        part = source.mapInArrow(_search(folded, prepared, cosine), f"id {kind}, {SCHEMA}")
        found = part if found is None else found.union(part)
    return found.withColumnRenamed("id", key)
