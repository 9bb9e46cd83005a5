"""Language by rank-order profiles: the out-of-place distance of a document's commonest n-grams.

Texts become runs of letters in lower case, framed by spaces. A profile lists the commonest n-grams
(1 to 3 characters, a lone space left out) by count, ties by code point. The distance of a document
to a language sums, over the document's profile, how many places each n-gram is off in the
language's profile; one that is missing there is off by the profile's full length. The profiles are
counted over all labelled documents; only they (languages times profile length) reach the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.llm.common import pieces, remembered

LENGTH, ORDERS, UNKNOWN = 300, 3, "und"
#: Languages a profile table may have: bounds what is sent to the tasks (20 bytes for each n-gram).
MOST_LANGUAGES = 2000
#: Letters of a text that are counted at a time.
STRIP = 1 << 20


@remembered
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Letters in lower case with one space (code 0) for each run of others, and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[points], points, 0).astype(np.int64)
    framed = np.concatenate([[0], codes, [0]])
    return framed[np.concatenate([[True], (framed[1:] != 0) | (framed[:-1] != 0)])]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text as numbers (21 bits a character), with their counts; empty without letters."""
    codes = _codes(text) if text else np.zeros(1, np.int64)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(codes), STRIP):
        # Strips overlap, so that an n-gram over their border is counted once.
        part = codes[at : at + STRIP + ORDERS - 1]
        value, all_ = np.zeros(len(part), np.int64), []
        for n in range(1, ORDERS + 1):
            value = (value[: len(part) - n + 1] << 21) | part[n - 1 :] if n > 1 else part + 1
            all_.append(value[: min(STRIP, len(codes) - at)])
            if n == 1:
                all_[0] = all_[0][all_[0] > 1]
        found.append(np.unique(np.concatenate(all_), return_counts=True))
    if len(found) == 1:
        return found[0]
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in found])).astype(np.int64)


def top_grams(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The commonest n-grams, best first; ties by number."""
    if len(keys) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:length]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, merged within the task and emitted when they grow large."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            parts = held[lang.as_py()]
            parts.append(grams(text.as_py()))
            if len(parts) > 256:
                held[lang.as_py()] = [merged(parts)]
        if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
            yield from _emit(held, merged)
            held.clear()
    yield from _emit(held, merged)


def _emit(held, merged) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        keys, counts = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"]
        )


def profiles(labelled: DataFrame, length: int = LENGTH) -> DataFrame:
    """(lang, gram, place from 0): the profile of each language of ``labelled`` (lang, text).

    Rows without a language are left out, and so are languages whose texts have no letter.
    """
    counted = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(
        _count, "lang string, gram long, n long"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(order) - 1)
    return ranked.where(F.col("place") < length).select("lang", "gram", "place")


def distances(own: np.ndarray, known: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Out-of-place distance of a profile to each language; ``places`` has a row for each known n-gram."""
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hit = known[at] == own
    off = np.full((len(own), places.shape[1]), length, np.int64)
    theirs = places[at[hit]]
    rank = np.arange(len(own))[hit][:, None]
    off[hit] = np.where(theirs < length, np.abs(theirs - rank), length)
    return off.sum(axis=0)


def predict(docs: DataFrame, profile: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs`` (key, text; other columns are not read).

    The nearest language, ties to the smaller name; ``und`` with score 0 for a null text, one without
    a letter, or without any profile. The score is 1 - distance / the largest possible distance.
    """
    rows = profile.limit(MOST_LANGUAGES * length + 1).collect()
    if len(rows) > MOST_LANGUAGES * length:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted({r.lang for r in rows})
    known = np.array(sorted({r.gram for r in rows}), np.int64)
    places = np.full((len(known), len(langs)), length, np.int64)
    for r in rows:
        places[np.searchsorted(known, r.gram), langs.index(r.lang)] = r.place

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            named, scores = [], []
            for text in batch.column("text"):
                own = top_grams(*grams(text.as_py()), length)
                if not len(own) or not langs:
                    named.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = distances(own, known, places, length)
                best = int(far.argmin())
                named.append(langs[best])
                scores.append(1 - float(far[best]) / (length * len(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), "text").mapInArrow(of, f"{key} {kind}, lang_pred string, score double")

