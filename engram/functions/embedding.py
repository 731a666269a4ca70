"""Texts to vectors: any function of distinct texts, and one that needs no model."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType

from engram.schema import DIMENSION

#: Texts that the model is asked for at once; their vectors are all that a task holds.
SLICE = 256
_SHAPE = 20  # last places, which describe the text's shape


def word_hash(word: str) -> int:
    """Signed 32-bit hash, 31 * h + c over the characters (a fixed value: vectors must be the same everywhere)."""
    h = 0
    for c in word:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def hashed_embedding(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector from the words of a text, their shares and first places; equal texts, equal vectors."""
    words = re.sub(r"[^a-z0-9\s]", "", text.lower()).split()
    quarter = dimension // 4
    out = np.zeros(dimension)
    first: dict[str, int] = {}
    counts: dict[str, int] = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
        counts[w] = counts.get(w, 0) + 1
    for w, at in first.items():
        h, share, place = word_hash(w), counts[w] / len(words), at / len(words)
        for i in range(4):
            out[(abs(h) % quarter + i * quarter) % dimension] += math.sin(h + i) * share + math.cos(h + i) * place
    mean = len(text) / len(words) if words else 0.0
    for i in range(_SHAPE):
        out[dimension - _SHAPE + i] = 0.1 * (math.sin(len(text) + i) + math.cos(len(words) + i) + math.sin(mean + i))
    size = float(np.sqrt(np.dot(out, out)))
    return out / size if size > 0 else out


def embed_distinct(texts: DataFrame, model: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, dimension: int = DIMENSION) -> DataFrame:
    """text and embedding of each distinct text; null where the model gives no finite vector of the right length.

    ``model`` takes a batch of up to SLICE texts; without one the hashed embedding is used.
    """

    schema = texts.select("text").schema.add("embedding", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                own = batch.slice(a, SLICE)
                told = [t or "" for t in own.column(0).to_pylist()]
                vectors = model(told) if model else [hashed_embedding(t, dimension) for t in told]
                checked = [np.asarray(v, float) for v in vectors]
                able = [v.shape == (dimension,) and bool(np.isfinite(v).all()) for v in checked]
                values = np.concatenate([v for v, ok in zip(checked, able) if ok] or [np.zeros(0)])
                ends = np.concatenate([[0], np.cumsum(able) * dimension]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([not ok for ok in able]))
                yield pa.RecordBatch.from_arrays([own.column(0), lists], names=["text", "embedding"])

    # no expression of the plan, so that a filter on the vectors does not ask the model twice
    return texts.select("text").distinct().mapInArrow(run, schema)


def embedder(model: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, dimension: int = DIMENSION) -> Callable[[DataFrame], DataFrame]:
    """embed_distinct with its model bound, as ingest and updates take it."""
    return lambda texts: embed_distinct(texts, model, dimension)
