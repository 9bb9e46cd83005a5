"""Match score of a query against a text: containment, shared words, sequence similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the match score.
CONTAINED_CAP, CONTAINED_BASE, CONTAINED_SPAN = 0.99, 0.7, 0.3
WORD_WEIGHT, SIMILARITY_WEIGHT, SCORE_THRESHOLD = 0.85, 0.75, 0.4

# Characters counted one by one for the bound on similarity; all others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _ratios(query: pd.Series, value: pd.Series) -> pd.Series:
    # A matcher keeps what it found out about its second text.
    matchers: dict[str, SequenceMatcher] = {}
    found = []
    for q, v in zip(query, value):
        if q is None:
            found.append(0.0)
            continue
        matcher = matchers.setdefault(v, SequenceMatcher(None, "", v))
        matcher.set_seq1(q)
        found.append(matcher.ratio())
    return pd.Series(found, dtype="float64")


def similarity(query: Column, value: Column) -> Column:
    """Ratcliff-Obershelp ratio, query first (the ratio is not symmetric); 0 for a null query."""
    return F.pandas_udf(_ratios, "double")(query, value)


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS occurs, and how many other characters there are."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS]
    others = F.length(F.regexp_replace(text, f"[{LETTERS}]", ""))
    return F.array(*each, others)


def similarity_bound(query_counts: Column, value_counts: Column) -> Column:
    """The ratio cannot exceed this value: twice the common characters over all characters."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0), lambda done, n: done + n)

    common = F.zip_with(query_counts, value_counts, lambda a, b: F.least(a, b))
    return 2 * total(common) / F.greatest(total(query_counts) + total(value_counts), F.lit(1))


def word_score(query: Column, value: Column) -> Column:
    """Share of the query's distinct words found in the value."""
    words = F.array_distinct(F.split(query, " "))
    shared = F.size(F.array_intersect(words, F.split(value, " ")))
    return shared / F.greatest(F.size(words), F.lit(1))


def match_score(query: Column, value: Column, sim: Column | None = None) -> Column:
    """Score in [0, 1] of normalised texts; without ``sim`` only containment and words count."""
    words = word_score(query, value)
    sim = F.lit(0.0) if sim is None else sim
    contained = F.lit(CONTAINED_BASE) + F.length(query) / F.greatest(F.length(value), F.lit(1)) * CONTAINED_SPAN
    mixed = F.when(
        F.greatest(words, sim) >= SCORE_THRESHOLD, F.greatest(words * WORD_WEIGHT, sim * SIMILARITY_WEIGHT)
    ).otherwise(0.0)
    return (
        F.when(value == "", 0.0)
        .when(query == value, 1.0)
        .when(value.contains(query), F.least(F.lit(CONTAINED_CAP), contained))
        .otherwise(mixed)
    )
