"""Text expressions shared by name resolution, overlap and blinding checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


# fixed values: words too common to count as content
STOP_WORDS = ("cell", "cells", "of", "the", "and", "in", "a", "an", "type", "types", "positive", "negative")


def content_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = 3) -> Column:
    """Distinct words of at least min_length characters that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= min_length) & ~F.array_contains(stops, w)))


# fixed value: what bounds a whole word
WORD_BOUNDS = ("(?iu)(?<![A-Za-z0-9])\\Q", "\\E(?![A-Za-z0-9])")


def whole_word(term: Column) -> Column:
    """Pattern that finds a literal term, in any case, not inside a longer run of letters and digits."""
    return F.concat(F.lit(WORD_BOUNDS[0]), term, F.lit(WORD_BOUNDS[1]))


# fixed value: a fenced block in a model's answer
FENCE = "(?is)```(?:json)?\\s*(.*?)```"


def json_payload(text: Column) -> Column:
    """The body of the first fenced block, or the whole text."""
    return F.trim(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct values."""
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


# fixed values: the reported bins of graph distances, as (above, up to, label)
DISTANCE_BINS = ((0, 1, "d=1"), (1, 2, "d=2"), (2, 3, "d=3"), (3, 5, "3<d<=5"), (5, 10, "5<d<=10"), (10, None, "d>10"))


def distance_bin(d: Column, bins: tuple = DISTANCE_BINS) -> Column:
    """Label of the half-open bin that holds a distance; null for null and for what no bin holds."""
    held = [F.when((d > low) & (F.lit(True) if high is None else d <= high), label) for low, high, label in bins]
    return F.coalesce(*held)
