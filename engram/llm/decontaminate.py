"""Benchmark decontamination by a prefix-filtered join of word shingles.

Every benchmark item gives windows of ten words (a shorter item is one window). A window occurs in a
document only if all of its shingles do, so one of them is enough as its necessary prefix: the one
that is rarest in the corpus. Two scans of the corpus do it, however large the benchmark is: the first
counts the benchmark's shingles in all documents, the second gives the places where a prefix occurs,
each with the words around it. Places and windows meet in an equi-join on the prefix; the window would
have to start inside the document (positional bound) and leave room for its words (length bound), and
the words are compared exactly.

Both sides are tables; a filter of bits (up to FILTER_BITS, 32 MB) lets the scans pass over nearly all
shingles of the corpus. In a benchmark of over eight million shingles the bits fill up, so that
more places than needed reach the join, which decides.

Defined results: null and empty texts have no words; items without words have no windows; equal
item ids are one item; a null item id is written as "null"; repeated items count once; equal rows each get their own result; an
empty table gives an empty result; an empty benchmark hits nothing; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import arrow
from engram.llm.rows import MAP_BITS, free_name, without_keys
from engram.storage import materialize, with_row_key

WINDOW = 10
#: Words in a shingle (fewer in windows of fewer words).
SHINGLE = 5
#: Bits of the filter at most, bits for each key, and places that a key sets.
FILTER_BITS, KEY_BITS, PLACES = 1 << 28, 32, 3
_TURN = 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: All of ASCII but digits and letters.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, words before each text, and word hashes."""
    buf, offsets = arrow.text_bytes(column)
    buf = _LOWER[buf]
    starts, ends, counts = arrow.word_bounds(buf, offsets, SEPARATOR)
    return buf, starts, ends, counts, arrow.word_hashes(buf, starts, ends)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (the size is part of the hash), and which lie in one text."""
    return arrow.mix(arrow.rolling(hashes, size) ^ np.uint64(size)), arrow.inside(counts, size)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (w, n words, size of a shingle, shingles) and their owners (w, item), written."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, starts, ends, counts, hashes = text_words(batch.column(1))
        by_size = {}
        for k, name in enumerate(batch.column(0).to_pylist()):
            low, high = int(counts[k]), int(counts[k + 1])
            n = min(window, high - low)
            if not n:
                continue
            size = min(shingle, n)
            if size not in by_size:
                by_size[size] = shingles(hashes, counts, size)[0].view(np.int64)
            own, words = by_size[size], [bytes(buf[a:b]) for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist())]
            for a in range(0, high - low - n + 1, 4096):
                b = min(a + 4096, high - low - n + 1)
                texts = [b" ".join(words[i : i + n]).decode() for i in range(a, b)]
                lists = own[(low + np.arange(a, b))[:, None] + np.arange(n - size + 1)].ravel()
                columns = [pa.array(texts, pa.string()), pa.array(np.full(b - a, n, np.int32)), pa.array(np.full(b - a, size, np.int32))]
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * (n - size + 1)), pa.array(lists)), pa.array([name] * (b - a), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["w", "n", "size", "shingles", "item"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col("text")).distinct()
    cuts = materialize(arrow.map_arrow(items, cut, "w string, n int, size int, shingles array<long>, item string"), "cuts")
    return materialize(cuts.select("w", "n", "size", "shingles").dropDuplicates(["w"]), "windows"), cuts.select("w", "item").distinct()


class Bits:
    """A filter of bits over 64-bit hashes: whether a hash may be among the keys."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = min(FILTER_BITS, max(MAP_BITS, 1 << (KEY_BITS * n - 1).bit_length())) if n else MAP_BITS
        places = F.array(*(F.shiftrightunsigned(column, k * _TURN).bitwiseAND(self.bits - 1) for k in range(PLACES)))
        place = keys.select(F.explode(places).alias("p")).select((F.col("p") + 1).alias("p"))
        maps = place.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
        held = np.zeros(self.bits // 8, np.uint8)
        for r in maps.toLocalIterator():  # FILTER_BITS in all
            held[(r["part"] - 1) * MAP_BITS // 8 :][: MAP_BITS // 8] = np.frombuffer(r["map"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(held)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be keys."""
        held, at = self.sent.value, np.arange(len(hashes))
        for k in range(PLACES):
            p = ((hashes[at] >> np.uint64(k * _TURN)) & np.uint64(self.bits - 1)).astype(np.int64)
            at = at[(held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        return at


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """w, n, size, prefix and offset (of the prefix in the window): the shingle that is rarest in all of ``docs`` (ties to the first)."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # SHINGLE at most
    each = windows.select("w", F.posexplode("shingles").alias("offset", "shingle"))
    asked = materialize(each.select("shingle").distinct(), "asked")
    bits = Bits(asked, "shingle")

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, _, _, counts, hashes = text_words(batch.column(0))
        for size in sizes:
            own, whole = shingles(hashes, counts, size)
            at = bits.among(own)
            found, times = np.unique(own[at[whole[at]]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "times"])

    found = arrow.map_arrow(docs.select("text"), count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    known = materialize(asked.join(found, "shingle", "left").na.fill(0), "counted")
    best = each.join(known, "shingle").groupBy("w").agg(F.min(F.struct("times", "offset", "shingle")).alias("best"))
    return materialize(windows.join(best, "w").select("w", "n", "size", F.col("best.shingle").alias("prefix"), F.col("best.offset").alias("offset")), "prefixes")


def places(keyed: DataFrame, key: str, chosen: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """For each text key and n_words, and for each of its places where a prefix may occur key, prefix, place, words around it and how many are before."""
    bits = Bits(chosen.select("prefix").distinct(), "prefix")

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, starts, ends, counts, hashes = text_words(batch.column(1))
        rows = batch.num_rows
        none = pa.nulls(rows, pa.int64())
        names = [key, "n_words", "prefix", "place", "before", "around"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(counts)), none, none, none, pa.nulls(rows, pa.string())], names=names)
        for size in sizes:
            own, whole = shingles(hashes, counts, size)
            at = bits.among(own)
            at = at[whole[at]]
            text = np.searchsorted(counts, at, side="right") - 1
            first = np.maximum(counts[text], at - (window - size))
            last = np.minimum(counts[text + 1], at + window)
            for a in range(0, len(at), 4096):
                some = slice(a, a + 4096)
                around = [b" ".join(bytes(buf[x:y]) for x, y in zip(starts[f:e].tolist(), ends[f:e].tolist())).decode() for f, e in zip(first[some].tolist(), last[some].tolist())]
                keys = batch.column(0).take(pa.array(text[some]))
                before, place = at[some] - first[some], at[some] - counts[text[some]]
                columns = [keys, pa.nulls(len(keys), pa.int64()), pa.array(own[at[some]].view(np.int64)), pa.array(place), pa.array(before), pa.array(around, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow.map_arrow(keyed.select(key, "text"), scan, f"{key} long, n_words long, prefix long, place long, before long, around string")


def find_windows(keyed: DataFrame, key: str, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts with a unique long key: (key, n_words) of each; (key, a, b, w) of each occurrence of a window; the windows' owners (w, item)."""
    windows, owners = benchmark_windows(benchmark, window)
    chosen = prefixes(keyed, windows)
    sizes = sorted(r[0] for r in chosen.select("size").distinct().collect())  # SHINGLE at most
    seen = materialize(places(keyed, key, chosen, window, sizes), "places")
    start = F.col("before") - F.col("offset")
    words = F.split("around", " ")
    fits = (start >= 0) & (start + F.col("n") <= F.size(words))
    same = F.when(fits, F.array_join(F.slice(words, (F.greatest(start, F.lit(0)) + 1).cast("int"), F.col("n")), " ") == F.col("w"))
    found = seen.where("prefix IS NOT NULL").drop("n_words").withColumnRenamed("prefix", "seen").join(chosen, (F.col("seen") == F.col("prefix")) & same)
    a = F.col("place") - F.col("offset")
    hits = materialize(found.select(key, a.alias("a"), (a + F.col("n")).alias("b"), "w"), "hits")
    return seen.where("prefix IS NULL").select(key, "n_words"), hits, owners


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated."""
    keyed = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "key")
    texts, hits, owners = find_windows(keyed, "key", benchmark, window)
    # words in the union of a text's intervals: what each reaches beyond all that start before it
    before = Window.partitionBy("key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("key", "a").agg(F.max("b").alias("b")).withColumn("reach", F.coalesce(F.max("b").over(before), F.lit(0)))
    words = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "reach"))).alias("n_hit"))
    items = hits.select("key", "w").distinct().join(owners, "w").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = keyed.select("key", "id").join(texts, "key").join(words, "key", "left").join(items, "key", "left")
    n_hit, own = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", own), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (text in column text) in which no window of the benchmark occurs."""
    key = free_name(docs, "__row_key")
    keyed = with_row_key(docs, id_col, key)
    _, hits, _ = find_windows(keyed, key, benchmark, window)
    return without_keys(keyed, hits, key).select(*docs.columns)
