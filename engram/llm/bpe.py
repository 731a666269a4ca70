"""Byte-level BPE by a rank file: overlapping chunks, stitched pre-tokens, encoded pieces, and back.

A text is scanned in chunks that overlap. The scan of a chunk starts at any place, so its first
boundaries may be wrong; but the pattern looks only forward, so from the first boundary that it
shares with the scan before it, all of its boundaries are right. Boundaries near the end of a chunk
are not trusted, as the pattern may look ahead. Where two scans share no boundary in the overlap,
the scan goes on from the last sure boundary. Texts of up to CHUNK characters are one chunk. Texts
above LONG_CHARS are cut into rows, so that many tasks scan one text, whose scans are then stitched.

Defined results: a null or empty text has no ids and decodes to nothing; equal rows each get their
own result; an empty table gives an empty result; other columns are left alone. A text is a valid
Unicode string, as Spark holds it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrow import map_arrow
from engram.storage import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters in a chunk, and of those the overlap with the next one.
CHUNK, OVERLAP = 1 << 12, 1 << 7
#: Longer texts are scanned by many tasks; characters of a row there.
LONG_CHARS, ROW_CHARS = 1 << 24, 1 << 20
#: The pattern's longest look beyond a match ('ll and the like after a quote).
LOOK = 4
#: Pieces that a worker remembers, and the longest of them.
MEMO_ENTRIES, MEMO_BYTES = 500_000, 40


class Codec:
    """Pieces to ids and ids to bytes; one per worker and rank file."""

    _all: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._all:
            cls._all[path, pattern] = cls(path, pattern)
        return cls._all[path, pattern]

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("by_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.memo: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.memo.get(piece)
        if ids is None:
            ids = np.asarray(self.library._encode_single_piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self.piece, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of the matches in text[start:stop], scanned from start; they follow each other without gaps."""
        return list(accumulate(map(len, self.pattern.findall(text, start, stop)), initial=start))[1:]


def stitch(scans: list[tuple[int, int, list[int]]], size: int, rescan: Callable[[int, int], list[int]]) -> list[int]:
    """True ends of all matches, from the scans of overlapping chunks (start, stop, ends), in order.

    rescan(a, b) gives the ends of a scan of [a, b).
    """
    sure: list[int] = []
    at = 0  # the last sure boundary
    for start, stop, ends in scans:
        # go on from the last sure boundary until the chunk's own scan has one of them
        while at != start and not _has(ends, at):
            there = min(size, at + OVERLAP)
            more = rescan(at, there)
            more = more[: _trusted(more, there, size)]
            if not more or at > stop - LOOK:
                ends = rescan(at, stop)
                break
            found = next((k for k, e in enumerate(more) if _has(ends, e)), len(more) - 1)
            sure += more[: found + 1]
            at = sure[-1]
        own = ends[bisect_right(ends, at) : _trusted(ends, stop, size)]
        if own:
            sure += own
            at = own[-1]
    if at < size:
        sure += rescan(at, size)
    return sure


def _has(ends: list[int], at: int) -> bool:
    k = bisect_left(ends, at)
    return k < len(ends) and ends[k] == at


def _trusted(ends: list[int], stop: int, size: int) -> int:
    """How many of the ends hold whatever follows ``stop``."""
    return len(ends) if stop >= size else bisect_right(ends, stop - LOOK)


def pre_tokens(text: str, codec: Codec, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The matches of the pattern in a whole text."""
    if len(text) <= chunk:
        return codec.pattern.findall(text)
    scans = []
    for start in range(0, len(text), chunk - overlap):
        stop = min(len(text), start + chunk)
        scans.append((start, stop, codec.ends(text, start, stop)))
        if stop == len(text):
            break
    return cut(text, stitch(scans, len(text), lambda a, b: codec.ends(text, a, b)))


def cut(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, long_chars: int = LONG_CHARS, row_chars: int = ROW_CHARS, digests: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_tokens, and digests of ids and decoded bytes, or without ``digests`` ids and decoded themselves (binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    types = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids binary, decoded binary"
    schema = f"{id_col} {kind}, {types}"

    def result(keys: pa.Array, pieces: Iterator[list[str]]) -> pa.RecordBatch:
        codec = Codec.of(ranks, pattern)
        counts, ids, decoded = [], [], []
        for own in pieces:
            coded = codec.encode(own)
            raw = codec.decode(coded)
            counts.append(len(coded) // 4)
            ids.append(hashlib.sha256(coded).hexdigest() if digests else coded)
            decoded.append(hashlib.sha256(raw).hexdigest() if digests else raw)
        form = pa.string() if digests else pa.binary()
        return pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(ids, form), pa.array(decoded, form)], names=[id_col, *names])

    def first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Results of texts of up to long_chars; the others cut into overlapping rows, under a fresh key each."""
        codec = Codec.of(ranks, pattern)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        short = [k for k, x in enumerate(texts) if len(x) <= long_chars]
        done = result(batch.column(0).take(pa.array(short, pa.int64())), (pre_tokens(texts[k], codec, chunk, overlap) for k in short))
        nothing = [pa.nulls(len(short), kind) for kind in (pa.string(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([*done.columns, *nothing], names=[*done.schema.names, "key", "start", "part"])
        for k in sorted(set(range(len(texts))) - set(short)):
            key = uuid.uuid4().hex
            for start in range(0, len(texts[k]), row_chars - overlap):
                empty = [pa.nulls(1, kind) for kind in done.schema.types[1:]]
                own = [pa.array([key]), pa.array([start], pa.int64()), pa.array([texts[k][start : start + row_chars]], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *empty, *own], names=[*done.schema.names, "key", "start", "part"])
                if start + row_chars >= len(texts[k]):
                    break

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        ends = [codec.ends(x, 0, len(x)) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], names=[id_col, "key", "start", "text", "ends"])

    def join(table: pa.Table) -> pa.Table:
        codec, rows = Codec.of(ranks, pattern), sorted(table.select(["start", "text", "ends"]).to_pylist(), key=lambda r: r["start"])
        parts, size = [], 0
        for r in rows:  # every row but the first repeats the overlap
            parts.append(r["text"][size - r["start"] :])
            size = r["start"] + len(r["text"])
        text = "".join(parts)
        scans = [(r["start"], r["start"] + len(r["text"]), [r["start"] + e for e in r["ends"]]) for r in rows]
        return pa.Table.from_batches([result(table.column(id_col).combine_chunks()[:1], iter([cut(text, stitch(scans, size, lambda a, b: codec.ends(text, a, b)))]))])

    wanted = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    passed = materialize(map_arrow(wanted, first, f"{schema}, key string, start long, part string"), "encoded")
    rows = passed.where(F.col("key").isNotNull()).select(id_col, "key", "start", F.col("part").alias("text")).repartition("key", "start")
    scanned = map_arrow(rows, scan, f"{id_col} {kind}, key string, start long, text string, ends array<int>")
    return passed.where(F.col("key").isNull()).select(id_col, *names).unionByName(scanned.groupBy("key").applyInArrow(join, schema))
