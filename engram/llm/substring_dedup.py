"""Repeated passages: every word covered by a window of words that also starts elsewhere is removed.

Each window of consecutive words has a Rabin-Karp hash; Spark counts the hashes, and the repeated
windows of a document merge into maximal removal intervals. Most windows occur once. They are kept
out of the shuffles by their anchor: the smallest of the hashes of the shorter word runs inside the
window, which equal windows share. Anchors are far fewer than windows (about one for every fifteen);
only windows whose anchor occurs twice are hashed and counted at all, so nothing is lost.

Windows are told apart by 64-bit hashes. Among n windows with repeated anchors some n * n / 2 ** 65
pairs may agree by chance (1e-4 for 60 million).

Phases, each written to the shared folder before the next: anchors; the repeated anchors of each
document; windows to be counted; the repeated windows' places in each document.

Defined results: a null or blank text has no words; a text shorter than a window is kept whole; wholly
repeated rows are documents of their own and so remove each other; an empty table gives an empty
result; columns other than the id and text are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import arrow
from engram.llm.arrow import map_arrow
from engram.storage import materialize, with_row_key

WINDOW = 35


def anchored(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside one text each, the places of their anchors, and the hashes of all short runs."""
    run = max(1, window // 4)
    width = window - run + 1
    starts = np.flatnonzero(arrow.inside(counts, window))
    short = arrow.rolling(hashes, run)
    if not len(starts):
        return starts, starts, short
    view = np.lib.stride_tricks.sliding_window_view(short, width)
    at = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 16):
        part = starts[a : a + (1 << 16)]
        at[a : a + (1 << 16)] = part + view[part].argmin(axis=1)
    return starts, at, short


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words before each text."""
    buf, offsets = arrow.text_bytes(column)
    starts, ends, counts = arrow.word_bounds(buf, offsets, arrow.SPACE)
    return arrow.word_hashes(buf, starts, ends), counts


def owner(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text a word belongs to."""
    return np.searchsorted(counts, at, side="right") - 1


def repeated_places(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_key and places: the first words (from 0) of the document's windows that occur elsewhere too."""

    def anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, counts = hashed(batch.column(1))
        _, at, short = anchored(words, counts, window)
        at = np.unique(at)
        keys = batch.column(0).to_numpy()[owner(counts, at)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(short[at].view(np.int64))], names=["row_key", "anchor"])

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, counts = hashed(batch.column(1))
        starts, at, short = anchored(words, counts, window)
        lists = batch.column(2)
        flat, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
        # a window counts if its text has its anchor among the repeated ones: pairs of both, looked up at once
        text = owner(counts, starts)
        wanted = np.sort(arrow.mix(flat ^ arrow.mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64))))
        mine = arrow.mix(short[at] ^ arrow.mix(text.astype(np.uint64)))
        found = np.searchsorted(wanted, mine)
        hit = wanted[np.minimum(found, len(wanted) - 1)] == mine if len(wanted) else np.zeros(len(mine), bool)
        starts, text = starts[hit], text[hit]
        own = arrow.rolling(words, window)[starts] if len(starts) else np.zeros(0, np.uint64)
        keys = batch.column(0).to_numpy()[text]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((starts - counts[text]).astype(np.int32)), pa.array(own.view(np.int64))], names=["row_key", "place", "hash"])

    found = materialize(map_arrow(keyed.select("row_key", "text"), anchors, "row_key long, anchor long"), "anchors")
    # written before the join, so that Spark may split the join where one anchor or window is very common
    often = materialize(found.groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    lists = materialize(found.join(often, "anchor").groupBy("row_key").agg(F.collect_set("anchor").alias("anchors")), "repeated")
    asked = keyed.select("row_key", "text").join(lists, "row_key")
    counted = materialize(map_arrow(asked, windows, "row_key long, place int, hash long"), "windows")
    again = materialize(counted.groupBy("hash").count().where("count > 1").select("hash"), "again")
    return materialize(counted.join(again, "hash").groupBy("row_key").agg(F.collect_list("place").alias("places")), "places")


def intervals(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words covered by windows at these places."""
    if not len(places):
        return []
    at = np.sort(places)
    cut = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + window).tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256; or without ``digests`` kept (the words left) and removed (intervals of words)."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = with_row_key(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col)
    places = repeated_places(keyed, window)
    last = "kept_sha256 string" if digests else "kept string, removed array<struct<start: long, end: long>>"

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        totals, removed, out, spans = [], [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2)):
            words = (text or "").encode().split()
            gone = intervals(np.asarray(own.values.to_numpy() if own.is_valid else [], np.int64), window)
            mask = np.ones(len(words), bool)
            for a, b in gone:
                mask[a:b] = False
            left = b" ".join(compress(words, mask.tolist()) if gone else words)
            totals.append(len(words))
            removed.append(len(words) - int(mask.sum()))
            out.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
            spans.append([{"start": a, "end": b} for a, b in gone])
        columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        names = [id_col, "n_words", "n_removed", "kept_sha256" if digests else "kept"]
        if not digests:
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names.append("removed")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = keyed.join(places, "row_key", "left").select(id_col, "text", "places")
    return map_arrow(joined, keep, f"{id_col} {kind}, n_words long, n_removed long, {last}")
