"""Recency, keyword and fused scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A profile never grows old.
TIMELESS = "personal_profile"
K1, B = 1.2, 0.75
#: Weights of similarity and recency that choose the page, and of the fused score.
PAGE_SIMILARITY, PAGE_RECENCY = 0.7, 0.3
FUSED_SIMILARITY, FUSED_KEYWORDS, FUSED_RECENCY, ENTITY_BOOST = 0.5, 0.25, 0.15, 0.1


def _decay(days: Column, kind: Column | None) -> Column:
    curve = 1.0 / (1.0 + F.log(1.0 + F.greatest(days, F.lit(0)).cast("double")))
    return curve if kind is None else F.when(kind == TIMELESS, F.lit(1.0)).otherwise(curve)


def recency_calendar(created: Column, now: Column, kind: Column | None = None) -> Column:
    """Decay by days whose boundaries lie between."""
    return _decay(F.datediff(now, created), kind)


def recency_elapsed(created: Column, now: Column, kind: Column | None = None) -> Column:
    """Decay by whole days of 24 hours that have passed."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return _decay(F.floor((micros(now) - micros(created)) / F.lit(86_400_000_000)), kind)


def page_score(similarity: Column, recency: Column) -> Column:
    return F.lit(PAGE_SIMILARITY) * similarity + F.lit(PAGE_RECENCY) * recency


def bm25_term(tf: Column, length: Column, average: Column, docs: Column, containing: Column) -> Column:
    """One term's part of the score; no stemming, no stop words."""
    idf = F.log((docs - containing + 0.5) / (containing + 0.5) + 1.0)
    return idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))


def fused_score(similarity: Column, keywords: Column, recency: Column, is_named: Column) -> Column:
    return FUSED_SIMILARITY * similarity + FUSED_KEYWORDS * keywords + FUSED_RECENCY * recency + F.when(is_named, ENTITY_BOOST).otherwise(0.0)
