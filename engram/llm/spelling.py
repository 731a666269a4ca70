"""Spelling variants of a corpus's words: near words by letter-parity masks in bands, and the form each word comes from.

A word's mask has a bit for each letter (rare letters share one): whether it occurs an odd number of times. One inserted
or deleted letter flips one bit, one replaced letter two or none. The bits are dealt to three bands, so that two near
words agree in at least one. Words meet where a band, the length and the number of bits (odd or even) are equal, and where
a band is equal with one letter and one flip more. Words that meet are dealt to cells of bounded size, in which masks that
differ too much and words that differ in both halves are passed over; what is left is verified letter by letter. Then every
word points to its most frequent near word if that occurs at least twice as often; as counts double along the way,
pointers end after few steps, which are halved each round.

Defined results: a null or empty text has no words; a null id counts as an empty string in the hash; equal rows all count;
very long words are words like others; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrow import map_arrow
from engram.storage import materialize

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One distinct run of a document in so many loses a letter.
DROP_ONE_IN = 97
#: A form occurs at least so many times as often as the word.
TIMES = 2
BANDS, BAND_BITS = 3, 10
#: Letters (with those of the Latin-1 block) by how frequent they are, so that dealing them in turn gives the bands as much to tell.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xE0, 0x100))) + "".join(map(chr, range(0xC0, 0xE0)))
#: Letters in one side of a cell, where no word is longer.
CELL_LETTERS = 1 << 22
#: Letters that a word counts for at least, so that a side of a cell holds 4,096 words at most; pairs compared at once.
_AT_LEAST, _PAIRS = 1 << 10, 1 << 19
#: Characters of distinct words that a task holds before it hands on their counts.
HELD = 1 << 22
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
#: Texts above so many characters are not split into a list of all their words.
_LISTED = 1 << 20


def _bits() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for i, letter in enumerate(LETTERS):
        out[ord(letter)] = 1 << (i % BANDS * BAND_BITS + i // BANDS % BAND_BITS)
    return out


_BIT = _bits()


def masks(words: list[str]) -> np.ndarray:
    """The letter-parity mask of each word (none of them empty)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum([len(w) for w in words])[:-1]].astype(np.int64)
    return np.bitwise_xor.reduceat(_BIT[letters], starts) if words else np.zeros(0, np.int32)


def runs(text: str) -> Counter[str]:
    """How often each run of letters of enough length stands in a text; only A-Z are lower-cased."""
    lower = text.encode().lower().decode()
    return Counter(_RUN.findall(lower) if len(lower) <= _LISTED else (m[0] for m in _RUN.finditer(lower)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of every word of at least LEAST_LETTERS letters; tasks count before Spark adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for run, n in runs(text.as_py()).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DROP_ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    if run not in held:
                        held[run] = n
                        size += len(run)
                    else:
                        held[run] += n
                if size > HELD:
                    yield given(held)
                    held, size = {}, 0
        if held:
            yield given(held)

    def given(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    wanted = docs.select(F.col(id_col).cast("string"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def flipped(a: np.ndarray, b: np.ndarray | None, flips: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of masks that differ in ``flips`` bits (or, where b is None and a meets itself, in none or so many), a block at a time."""
    step = max(1, _PAIRS // max(1, len(a if b is None else b)))
    for s in range(0, len(a), step):
        others = a[s:] if b is None else b
        bits = np.bitwise_count(a[s : s + step, None] ^ others)
        x, y = np.nonzero((bits == flips) | (bits == 0) if flips == 2 else bits == flips)
        if b is None:
            x, y = x[y > x], y[y > x]
        yield x + s, y + (s if b is None else 0)


def one_edit(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows of two letter matrices, b as wide as a or one wider: whether one replaced or inserted letter tells them apart."""
    width, half = a.shape[1], a.shape[1] // 2
    # one edit leaves one half as it is
    heads = np.arange(1, width + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    head_a, head_b = (m[:, :half].astype(np.uint64) @ heads[:half] for m in (a, b))
    tail_a, tail_b = (m[:, m.shape[1] - (width - half) :].astype(np.uint64) @ heads[: width - half] for m in (a, b))
    out = (head_a[x] == head_b[y]) | (tail_a[x] == tail_b[y])
    left = np.flatnonzero(out)
    step = max(1, _PAIRS // width)
    for s in range(0, len(left), step):
        some = left[s : s + step]
        p, q = a[x[some]], b[y[some]]
        if b.shape[1] == width:
            out[some] = (p != q).sum(axis=1) == 1
        else:
            differs = p != q[:, :width]
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
            out[some] = ~((p != q[:, 1:]) & (np.arange(width) >= first[:, None])).any(axis=1)
    return out


def meet(cell: pa.Table) -> pa.Table:
    """Pairs of near words among the rows of one cell: own words (role 0), others as long (1), and words one letter longer (2)."""
    band, role, mask = cell["band"][0].as_py(), cell["role"].to_numpy(), cell["mask"].to_numpy().view(np.uint32)
    sides = [np.flatnonzero(role == r) for r in range(3)]

    def letters(rows: np.ndarray) -> np.ndarray:
        joined = "".join(cell["word"].take(rows).to_pylist()).encode("latin-1")
        return np.frombuffer(joined, np.uint8).reshape(len(rows), -1)

    found = []
    for flips, other in ((2, 0 if cell["i"][0].as_py() == cell["j"][0].as_py() else 1), (1, 2)):
        mine, theirs = sides[0], sides[other]
        if not len(mine) or len(theirs) < (2 if other == 0 else 1):
            continue
        a, b = letters(mine), letters(theirs)
        for x, y in flipped(mask[mine], None if other == 0 else mask[theirs], flips):
            changed = mask[mine[x]] ^ mask[theirs[y]]
            new = np.ones(len(x), bool)  # a pair that agrees in several bands is told in the first of them
            for k in range(band):
                new &= changed & np.uint32(((1 << BAND_BITS) - 1) << (BAND_BITS * k)) != 0
            x, y = x[new], y[new]
            near = one_edit(a, b, x, y)
            found.append((mine[x[near]], theirs[y[near]]))
    x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    columns = [cell["word"].take(x), cell["n"].take(x), cell["word"].take(y), cell["n"].take(y)]
    return pa.Table.from_arrays(columns, names=["word", "n", "other", "other_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every ordered pair of distinct words that differ by one inserted, deleted or replaced letter."""

    def masked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks(batch.column(0).to_pylist()), pa.int32())], names=["word", "n", "mask"])

    rows = map_arrow(words.select("word", "n"), masked, "word string, n long, mask int")
    bands = F.array(*(F.shiftright("mask", BAND_BITS * b).bitwiseAND((1 << BAND_BITS) - 1) for b in range(BANDS)))
    key = ["band", "value", "letters", "odd"]
    banded = materialize(
        rows.select("word", "n", "mask", F.length("word").alias("letters"), (F.bit_count("mask") % 2).alias("odd"), F.posexplode(bands).alias("band", "value")), "banded"
    )
    parts = F.ceil(F.count("*") * F.greatest(F.col("letters"), F.lit(_AT_LEAST)) / CELL_LETTERS).cast("int")
    sizes = materialize(banded.groupBy(*key).agg(parts.alias("parts"), F.count("*").alias("rows")), "sizes")
    beside = sizes.select("band", "value", "letters", "odd", "parts")
    longer = beside.select("band", "value", (F.col("letters") - 1).alias("letters"), (1 - F.col("odd")).alias("odd"), F.col("parts").alias("longer"))
    shorter = beside.select("band", "value", (F.col("letters") + 1).alias("letters"), (1 - F.col("odd")).alias("odd"), F.col("parts").alias("shorter"))
    known = sizes.join(longer, key, "left").join(shorter, key, "left").na.fill(0, ["longer", "shorter"])
    dealt = banded.join(known, key).withColumn("c", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # which cells a row goes to: own ones, those of its own length that began before it, those of words one letter shorter
    to = """concat(
        CASE WHEN rows > 1 OR longer > 0 THEN transform(filter(sequence(0, greatest(parts, longer) - 1), j -> j >= c OR j < longer),
            j -> struct(letters AS letters, odd AS odd, c AS i, j AS j, 0 AS role)) ELSE array() END,
        CASE WHEN c > 0 THEN transform(sequence(0, c - 1), i -> struct(letters AS letters, odd AS odd, i AS i, c AS j, 1 AS role)) ELSE array() END,
        CASE WHEN shorter > 0 THEN transform(sequence(0, shorter - 1), i -> struct(letters - 1 AS letters, 1 - odd AS odd, i AS i, c AS j, 2 AS role)) ELSE array() END)"""
    cells = dealt.select("word", "n", "mask", "band", "value", F.explode(F.expr(to)).alias("to")).select("word", "n", "mask", "band", "value", "to.*")
    pairs = cells.groupBy("band", "value", "letters", "odd", "i", "j").applyInArrow(meet, "word string, n long, other string, other_n long")
    pairs = materialize(pairs, "near")
    return pairs.unionByName(pairs.toDF("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for a frame of word and form without circles: the last word that forms lead to."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus that occurs often enough."""
    words = materialize(word_counts(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    told = words.join(best, "word", "left")
    takes = -F.col("best.less") >= TIMES * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    told = materialize(told, "told")
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
