"""Arrow batches in and out of Python workers, and vectorised word arithmetic on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Bytes of text that one vectorised step holds at once (each costs some 60 bytes of memory).
SLICE_BYTES = 1 << 20
#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a function of one batch of about ``most`` bytes of text; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of its text column; a longer row stands alone."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index("text")
    if at < 0:
        yield batch
        return
    sizes = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of words, and the number of words before each text (n + 1)."""
    word = ~separator[buf]
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[first], after[last] = False, False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        have = tuple(both)
        if size <= 1 << 21:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that all bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash per word, from prefix sums of a polynomial over the bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # as many words as fit a slice; at least one
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        j = min(j, len(starts))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(_BASES[which], b - a)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def rolling(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of each ``size`` consecutive words (as many as there are such windows)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 20
    for a in range(0, n, step):
        b = min(n, a + step)
        part = words[a : b + size - 1]
        up, down = powers(_BASES[1 - which], len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * up, out=total[1:])
        out[a:b] = mix((total[size:] - total[:-size]) * down[: b - a])
    return out


def inside(counts: np.ndarray, size: int) -> np.ndarray:
    """Of windows over texts laid end to end (counts: words before each text, n + 1), which lie in one text."""
    n = int(counts[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + size, bool)
    lengths = np.diff(counts)
    for back in range(1, size):  # starts at which a window would pass the end of its text
        at = counts[1:][lengths >= 1] - back
        ok[at[at >= 0]] = False
    return ok[:n]
