"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    """A balanced sum, so that long vectors do not make deep expressions."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + (terms[-1:] if len(terms) % 2 else [])
    return terms[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; null if either has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """Cosine similarity to a known vector, unrolled so that it runs in generated code."""
    own = [a[i].cast("double") for i in range(len(vector))]
    size = sum(v * v for v in vector) ** 0.5
    top = _sum([x * F.lit(float(v)) for x, v in zip(own, vector)])
    return F.try_divide(top, F.sqrt(_sum([x * x for x in own])) * F.lit(size))


def statistics(a: Column) -> dict[str, Column]:
    """Mean, population deviation, norm, least and largest element of a vector."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    spread = F.aggregate(F.transform(a, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean)), F.lit(0.0), lambda s, x: s + x) / n
    return {"mean": mean, "stddev": F.sqrt(spread), "norm": norm(a), "least": F.array_min(a).cast("double"), "largest": F.array_max(a).cast("double"), "dims": n}
