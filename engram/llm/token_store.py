"""Token ids in plane-shuffled binary files, written by ranges of document ids and read back.

A file holds the ids of consecutive documents, each with an end id. Ids are cut into blocks of a
fixed number; a block's 32-bit ids are transposed into byte planes (or bit planes), so that equal
high bytes lie together, and every plane is compressed with zstandard. At the end of the file stand
the documents' index (ids and lengths, as an Arrow stream), the chunk index (offset, number of ids
and the planes' sizes, for each block), and a trailer with both places.

Files are written under names of their task attempts; only those of finished tasks enter the
manifest, so a lost executor or a second attempt leaves nothing that is read.

Defined results: a null or empty text holds the end id alone; null ids come first; equal ids follow
each other by a hash of the text; an empty table gives an empty manifest and result; other columns are left alone.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.arrow import slices
from engram.llm.encoding import SEGMENT, Encoder
from engram.storage import new_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Ids in a block.
BLOCK = 1 << 16
MAGIC = b"EGRTOK01"
_TRAILER = struct.Struct("<QQQQQ8s")  # index offset, index size, chunk index offset, chunks, ids, magic
LEVEL = 1


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of 32-bit ids, lowest first; bytes (4) or bits (32)."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again, from 4 byte planes or 32 bit planes; an empty plane is all zero."""
    if len(planes) == 4:
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                out[:, k] = np.frombuffer(plane, np.uint8, n)
    else:
        spread = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                spread[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        out = np.packbits(spread, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class Writer:
    """One file; holds at most a block of ids beside the documents' index."""

    def __init__(self, sink, bits: bool = False) -> None:
        self.sink, self.bits, self.at, self.ids = sink, bits, 0, 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.index: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) if p.strip(b"\0") else b"" for p in to_planes(ids, self.bits)]
        self.index.append(struct.pack(f"<QII{len(packed)}I", self.at, len(ids), len(packed), *map(len, packed)))
        for p in packed:
            self._put(p)

    def add(self, ids: np.ndarray) -> None:
        """Further ids, of as many documents as may be, their end ids included."""
        self.held.append(np.asarray(ids, "<u4"))
        self.held_ids += len(ids)
        self.ids += len(ids)
        if self.held_ids >= BLOCK:
            whole = np.concatenate(self.held)
            used = len(whole) // BLOCK * BLOCK
            for a in range(0, used, BLOCK):
                self._block(whole[a : a + BLOCK])
            self.held, self.held_ids = [whole[used:].copy()], len(whole) - used

    def close(self, documents: pa.Table) -> None:
        if self.held_ids:
            self._block(np.concatenate(self.held))
        stream = io.BytesIO()
        with pa.ipc.new_stream(stream, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(documents)
        at = self.at
        self._put(stream.getvalue())
        chunks_at = self.at
        for entry in self.index:
            self._put(entry)
        self._put(_TRAILER.pack(at, chunks_at - at, chunks_at, len(self.index), self.ids, MAGIC))


def read_file(source) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """A file's documents (id, n_tokens) and its ids block by block."""
    size = source.size()
    source.seek(size - _TRAILER.size)
    at, length, chunks_at, chunks, _, magic = _TRAILER.unpack(source.read(_TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a token file, or cut short")
    source.seek(at)
    documents = pa.ipc.open_stream(source.read(length)).read_all()
    source.seek(chunks_at)
    index = source.read(size - _TRAILER.size - chunks_at)

    def blocks() -> Iterator[np.ndarray]:
        unzip, p = zstandard.ZstdDecompressor(), 0
        for _ in range(chunks):
            offset, n, k = struct.unpack_from("<QII", index, p)
            sizes = struct.unpack_from(f"<{k}I", index, p + 16)
            p += 16 + 4 * k
            source.seek(offset)
            planes = [source.read(s) for s in sizes]
            yield from_planes([unzip.decompress(x) if x else b"" for x in planes], n)

    return documents, blocks()


def open_path(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path with a scheme."""
    scheme, _, rest = path.partition("://")
    return pa.fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as Spark itself would read it; an error where workers cannot open files there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        open_path(full)
    except (ValueError, OSError, pa.ArrowException) as e:
        raise ValueError(f"token files need a folder that Arrow can open; {full} is none: {e}") from e
    return full


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, bits: bool = False) -> list[dict]:
    """Write the files; the manifest has one entry a file, in order: file, n_docs, n_ids, start.

    The texts are dealt by ranges of the id and a hash of the text, so that many rows of one id
    (or none) are split, and sorted within them, so files follow each other.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs, name, writer, sink, ids, sizes = TaskContext.get().partitionId(), None, "", None, None, [], []
        for whole in batches:
            for batch in slices(whole, SEGMENT):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    fs, path = open_path(name)
                    sink = fs.open_output_stream(path)
                    writer = Writer(sink, bits)
                encoded, before = Encoder.of(tokenizer).encode(batch.column(1))
                writer.add(np.insert(encoded, before[1:], end_id))
                ids.append(batch.column(0))
                sizes.append(pa.array(np.diff(before) + 1, pa.int64()))
        if writer is not None:
            writer.close(pa.table([pa.chunked_array(ids), pa.chunked_array(sizes)], names=["id", "n_tokens"]))
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [sum(map(len, sizes))], "n_ids": [writer.ids]})

    folder = qualified(docs.sparkSession, folder)
    dealt = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("turn")).repartitionByRange(id_col, "turn")
    dealt = dealt.sortWithinPartitions(id_col, "turn", "text").select(id_col, "text")
    rows = dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long").collect()  # one row a file
    manifest, start = [], 0
    for r in sorted(rows):
        manifest.append({"file": r.file, "n_docs": r.n_docs, "n_ids": r.n_ids, "start": start})
        start += r.n_ids
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], id_type: str = "long", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the files: id, start, n_tokens, ids_crc32, and with_ids the ids themselves."""
    extra = ", ids array<long>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_path(file)
                with fs.open_input_file(path) as source:
                    documents, blocks = read_file(source)
                    sizes = documents.column("n_tokens").to_numpy()
                    crc, held, own, k, left = [], 0, [], 0, int(sizes[0]) if len(sizes) else 0
                    lists: list[list[int]] = []
                    for block in blocks:
                        p = 0
                        while p < len(block):
                            piece = block[p : p + left]
                            held = zlib.crc32(piece.tobytes(), held)
                            if with_ids:
                                own.extend(piece.tolist())
                            p, left = p + len(piece), left - len(piece)
                            if not left:
                                crc.append(held)
                                lists.append(own)
                                held, own, k = 0, [], k + 1
                                left = int(sizes[k]) if k < len(sizes) else 0
                starts = start + np.cumsum(sizes) - sizes
                columns = [documents.column("id").combine_chunks(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
                table = pa.table(columns, names=names)
                yield from table.to_batches(max_chunksize=10_000)

    files = [(m["file"], m["start"]) for m in manifest]
    paths = spark.createDataFrame(files, "file string, start long")
    if files:
        paths = paths.repartition(len(files))
    return paths.mapInArrow(read, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long{extra}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, bits: bool = False, with_ids: bool = False) -> DataFrame:
    """Write all documents' ids, then give what the files hold."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, folder or new_folder(spark, "tokens"), id_col, text_col, bits=bits)
    return read_tokens(spark, manifest, docs.schema[id_col].dataType.simpleString(), id_col, with_ids)
