"""SimHash near-duplicates: fingerprints, exact Hamming links by bit-sliced comparison, components.

Fingerprints within the radius agree on at least two of five blocks of bits (three differing bits
spoil three blocks at most), so each distinct fingerprint is dealt to ten buckets, one for each pair
of blocks. A bucket is compared bit-sliced: bit b of all its fingerprints lies in one row of machine
words, the row is compared with itself shifted by a lag, and three carry-save counters hold 64
distances a word; words in which every distance has passed the radius are abandoned. Links within a
bucket go on as a spanning forest, never as all pairs. A bucket with too many fingerprints is dealt
to a grid of cells, each pair of its parts meeting in one cell, so that no task holds it whole.

Sixty-four bits tell only very close copies (three bits stand for a cosine of about 0.99). For texts
that share four fifths of their five-word shingles, ``similar_documents`` makes fingerprints of 1,024
bits from their sets of shingles, and buckets from bands of three least hashes (two texts of similarity
0.8 share at least one of sixteen bands with probability 0.99999). The bit-sliced comparison within
buckets, with a radius that a pair of similarity 0.8 passes with probability 1e-6, leaves groups of
texts that may be similar; only their sets are made and compared, exactly.

Defined results: a null, empty or blank text has no shingles and fingerprint zero, linked like any
other; a text with fewer words than a shingle has one shingle, the whole; equal rows have equal
fingerprints; a null id counts as no candidate for the smallest id; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrow import SPACE, map_arrow, mix, rolling, text_bytes, word_bounds, word_hashes
from engram.llm.components import components
from engram.storage import filtered_joins, materialize, settle, with_row_key

RADIUS = 3
SHINGLE = 3
SEED = 42
#: (first bit, bits) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that one part of a split bucket holds; buckets of up to twice that stay whole.
PART = 2048

#: Words of a shingle and least similarity of sets of shingles for similar_documents.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 3
#: Bits of their fingerprints, and nodes that one part of a split bucket of them holds.
WIDE_BITS, WIDE_PART = 1024, 400
#: Sets of fewer shingles are compared whatever their fingerprints, whose bits depend on single shingles.
FEW = 16
#: Shingles that one part of a split group holds.
MOST_SHINGLES = 4_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_values(texts: list[str | None], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            continue
        whole = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        if len(words) < size:
            starts, ends = [0], [len(whole)]
        else:
            starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
        ones = np.zeros(64, np.int64)
        for a in range(0, len(starts), 1 << 14):
            h = np.fromiter([xxh64_intdigest(whole[i:j], seed) for i, j in zip(starts[a : a + (1 << 14)], ends[a : a + (1 << 14)])], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = fingerprint_values(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """A row of machine words for each bit; bit i of row b is bit b of fingerprint i (one or more words each)."""
    fp = fp.reshape(len(fp), -1)
    padded = np.zeros((-(-len(fp) // 64) * 64, fp.shape[1]), np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def differences(planes: np.ndarray, lag: int, n: int) -> np.ndarray:
    """Planes of the bits in which i and i + lag differ, for i < n - lag."""
    jump, bit = divmod(lag, 64)
    used = -(-(n - lag) // 64)
    there = planes[:, jump : jump + used]
    if bit:
        there = there >> np.uint64(bit)
        above = planes[:, jump + 1 : min(planes.shape[1], jump + 1 + used)] << np.uint64(64 - bit)
        there[:, : above.shape[1]] |= above
    return planes[:, :used] ^ there


def within(planes: np.ndarray, lag: int, n: int, radius: int = RADIUS) -> np.ndarray:
    """All i < n - lag whose fingerprint differs from that of i + lag in at most ``radius`` bits.

    Counters are vertical and start so high that the one distance past the radius overflows them.
    """
    differ = differences(planes, lag, n)
    used = differ.shape[1]
    alive = np.arange(used)
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    state = [np.full(used, _ONES if start >> k & 1 else 0, np.uint64) for k in range(size)] + [np.zeros(used, np.uint64)]
    step = 8 if radius <= 3 else 64
    for b in range(0, len(differ), step):
        for k in range(b, b + step, 2):
            _count_two(state, differ[k], differ[k + 1])
        if b + step < len(differ):
            keep = state[-1] != _ONES
            if not keep.any():
                return np.zeros(0, np.int64)
            if not keep.all():
                state, differ, alive = [c[keep] for c in state], differ[:, keep], alive[keep]
    lanes = np.flatnonzero(np.unpackbits((~state[-1]).view(np.uint8), bitorder="little"))
    found = alive[lanes // 64] * 64 + lanes % 64
    return found[found < n - lag]


def _count_two(state: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
    """Add two planes to the counters: a carry-save step into the lowest, then the carry upwards; the last word marks overflow."""
    either = x ^ y
    carry = (x & y) | (either & state[0])
    state[0] = state[0] ^ either
    for k in range(1, len(state) - 1):
        up = state[k] & carry
        state[k] = state[k] ^ carry
        carry = up
    state[-1] = state[-1] | carry


def roots_of(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of n, from labels so far and further pairs."""
    u = np.concatenate([np.arange(n), *(p[0] for p in pairs)])
    v = np.concatenate([label, *(p[1] for p in pairs)])
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[label])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest_rows(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row numbers) of a spanning forest of the links within buckets; rows sorted by bucket."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[at, len(bucket)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, high in ((2, 4), (5, 16), (17, 128), (129, 1024), (1025, 1 << 40)):
        pick = (sizes >= low) & (sizes <= high)
        if not pick.any():
            continue
        rows = np.concatenate([np.arange(a, a + s) for a, s in zip(at[pick], sizes[pick])])
        own = bucket[rows]
        n, planes, label, pairs, held = len(rows), planes_of(fp[rows]), np.arange(len(rows)), [], 0
        for lag in range(1, int(sizes[pick].max())):
            i = within(planes, lag, n, radius)
            i = i[(own[i] == own[i + lag]) & (label[i] != label[i + lag])]
            if len(i):
                pairs.append((i, i + lag))
                held += len(i)
                if held > 4 * n or lag < 3:
                    label, pairs, held = roots_of(n, pairs, label), [], 0
                    if (label == np.arange(n)).sum() == pick.sum():
                        break  # every bucket is one component
        label = roots_of(n, pairs, label)
        moved = np.flatnonzero(label != np.arange(n))
        left.append(rows[label[moved]])
        right.append(rows[moved])
    return np.concatenate(left), np.concatenate(right)


def bucket_forest(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprints) of a spanning forest of the links within buckets; rows sorted by bucket."""
    u, v = forest_rows(bucket, fp, radius)
    return fp[u], fp[v]


def deal_cells(keyed: DataFrame, node: str) -> DataFrame:
    """Deal rows of columns bucket, parts and ``node`` to cells: a bucket of one part is a cell; of more, each pair of parts meets in one."""
    split = keyed.withColumn("own", F.pmod(F.xxhash64(node), F.coalesce("parts", F.lit(1))).cast("int"))
    cells = F.expr("CASE WHEN coalesce(parts, 1) = 1 THEN array(bucket) ELSE transform(filter(sequence(0, parts - 1), x -> x <> own), x -> xxhash64(bucket, least(x, own), greatest(x, own))) END")
    return split.select(node, F.explode(cells).alias("bucket"))


def links(nodes: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Edges u, v (fingerprints) that connect all fingerprints of ``nodes`` (distinct fp) as their links do."""
    block = [f"(shiftrightunsigned(fp, {first}) & {(1 << bits) - 1}L)" for first, bits in BLOCKS]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    keys = ", ".join(f"xxhash64({k}, {block[i]}, {block[j]})" for k, (i, j) in enumerate(pairs))
    keyed = nodes.select("fp", F.explode(F.expr(f"array({keys})")).alias("bucket"))
    hot = keyed.groupBy("bucket").count().where(F.col("count") > 2 * part).select("bucket", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    hot = materialize(hot, "hot")
    if not hot.isEmpty():
        keyed = deal_cells(keyed.join(hot, "bucket", "left"), "fp")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(b: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = bucket_forest(b, f, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            b = np.r_[rest_b, batch.column(0).to_numpy()]
            f = np.r_[rest_f, batch.column(1).to_numpy().view(np.uint64)]
            end = int(np.searchsorted(b, b[-1])) if len(b) else 0  # the last bucket may go on
            if end:
                yield from out(b[:end], f[:end])
            rest_b, rest_f = b[end:], f[end:]
        yield from out(rest_b, rest_f)

    return keyed.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(forest, "u long, v long")


def _named(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node, component_id from nodes (node, first) and the roots of those that have a link."""
    named = nodes.select(node, "first").join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    named = materialize(named, "roots")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.select(node, "root").join(lowest, "root").select(node, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    printed = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(printed.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    of = _named(nodes, components(links(nodes.select("fp"), radius)), "fp")
    return printed.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int = WIDE_BITS) -> int:
    """Bits in which sets of shingles of at least that Jaccard similarity differ at most, but for a chance of 1e-6."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def wide_sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (WIDE_BITS bits as machine words) and band keys of a set of shingle hashes."""
    odd = mix(np.arange(1, WIDE_BITS // 64 + BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    seeds, turns = odd[: WIDE_BITS // 64], odd[WIDE_BITS // 64 :]
    ones, least = np.zeros(WIDE_BITS, np.int64), np.full(len(turns), _ONES, np.uint64)
    for a in range(0, len(hashes), 255):  # so that a byte holds each sum
        h = hashes[a : a + 255, None]
        ones += np.add.reduce(np.unpackbits(mix(h * seeds).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        least = np.minimum(least, mix(h * turns).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for band in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + band)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64), keys


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of hashes, in order, of each text's lower-cased shingles."""
    buf, offsets = text_bytes(column)
    buf = np.frombuffer(_LOWER, np.uint8)[buf]
    starts, ends, counts = word_bounds(buf, offsets, SPACE)
    words = word_hashes(buf, starts, ends)
    windows = rolling(words, size)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
        yield np.zeros(0, np.uint64) if a == b else np.unique(mix(windows[a : b - size + 1] if b - a >= size else rolling(words[a:b], b - a)))


def wide_sketches(keyed: DataFrame, key: str, size: int) -> DataFrame:
    """key, node (hash of the set of shingles), n (shingles), fp (wide fingerprint) and keys (of its buckets) of every text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        node, n, prints, keys = [], [], [], []
        for own in shingle_sets(batch.column(1), size):
            fp, bands = wide_sketch(own) if len(own) else (np.zeros(WIDE_BITS // 64, np.uint64), np.zeros(0, np.uint64))
            node.append(xxh64_intdigest(own.tobytes(), SEED))
            n.append(len(own))
            prints.append(fp.tobytes())
            keys.append(bands.view(np.int64))
        columns = [batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[key, "node", "n", "fp", "keys"])

    return map_arrow(keyed.select(key, "text"), run, f"{key} long, node long, n long, fp binary, keys array<long>")


def near_pairs(nodes: DataFrame, similarity: float, part: int = WIDE_PART) -> DataFrame:
    """Edges u, v (u < v) that connect all of ``nodes`` (distinct node; n, fp, keys) whose sketches do not rule out ``similarity``.

    Buckets with the same members are one. Sets of few shingles pass on their buckets alone, the
    others if their fingerprints are near; a bucket too large goes to a grid of cells.
    """
    keyed = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    members = F.struct(F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node")), F.count("*"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("count"), F.xxhash64(members).alias("same")).where("count > 1")
    shared = materialize(shared.select("bucket", "same", F.when(F.col("count") > 2 * part, F.ceil(F.col("count") / part)).otherwise(1).cast("int").alias("parts")), "shared")
    # few buckets are shared; their table grows with the corpus, so it is never sent to all tasks
    with filtered_joins(nodes.sparkSession):
        groups = keyed.join(shared.where("parts > 0").hint("merge"), "bucket").select("node", "n", F.col("same").alias("bucket"), "parts").distinct()
        groups = materialize(groups, "groups")
    few = groups.where(F.col("n") < FEW).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    least = few.groupBy("bucket").agg(F.min("node").alias("u"), F.min("parts").alias("parts"))
    least = least.select("bucket", "u", F.explode(F.expr("sequence(0, parts - 1)")).alias("own"))  # one for each part of a large bucket
    stars = few.join(least, ["bucket", "own"]).where("u < node").select("u", F.col("node").alias("v"))
    dealt = deal_cells(groups.where(F.col("n") >= FEW - FEW // 4).select("node", "bucket", "parts"), "node").join(nodes.select("node", "fp"), "node")
    radius, words = radius_of(similarity), WIDE_BITS // 64

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64))

        def out(b: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = forest_rows(b, fp, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, words)
            b, node, fp = (np.concatenate(x) for x in zip(rest, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp)))
            end = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            if end:
                yield from out(b[:end], node[:end], fp[:end])
            rest = (b[end:], node[end:], fp[end:])
        if len(rest[0]):
            yield from out(*rest)

    found = dealt.select("bucket", "node", "fp").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(forest, "u long, v long")
    return found.unionByName(stars).distinct()


def exact_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges (places) of a spanning forest of the pairs of sets whose Jaccard similarity is ``similarity`` or more."""
    left, right = [], []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    rest, mine = np.arange(len(sets)), np.zeros(len(names), bool)
    ends = np.cumsum(sizes)
    rows = [flat[e - s : e] for e, s in zip(ends, sizes)]
    reached: list[int] = []
    while len(rest):
        i = reached.pop() if reached else int(rest[0])
        rest = rest[rest != i]
        near = rest[(np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]))]
        if not len(near):
            continue
        mine[rows[i]] = True
        shared = np.add.reduceat(mine[np.concatenate([rows[j] for j in near])].astype(np.int64), np.r_[0, np.cumsum(sizes[near])[:-1]])
        mine[rows[i]] = False
        found = near[shared >= similarity * (sizes[near] + sizes[i] - shared)]
        if len(found):
            left += [i] * len(found)
            right += found.tolist()
            reached += found.tolist()
            rest = np.setdiff1d(rest, found)
    return left, right


def cell_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """Edges u, v of the exact links within cells; dealt: bucket, node, shingles. A task holds one cell at a time."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, node, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                u, v = exact_forest(sets, similarity)
                if u:
                    own = np.array(node, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own[u]), pa.array(own[v])], names=["u", "v"])

        for batch in batches:
            for b, k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != bucket:
                    yield from out()
                    bucket, node, sets = b, [], []
                node.append(k)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
        yield from out()

    return dealt.select("bucket", "node", "shingles").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(forest, "u long, v long")


def pair_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets (node, shingles) have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def large_links(sets: DataFrame, pairs: DataFrame, similarity: float, part: int) -> DataFrame:
    """Exact links of groups too large for one task; sets: node, root (the group), n, shingles.

    First at most three pairs a node are asked, so that a group of copies falls together at a cost in
    proportion to its size. What a group's largest part does not hold then is compared with the whole
    group, in a grid of cells.
    """
    node = sets.select("node", "root", "n")
    own = pairs.join(node.select(F.col("node").alias("v")), "v", "left_semi").groupBy("v").agg(F.array(F.min("u"), F.max("u"), F.min_by("u", F.xxhash64("u", "v"))).alias("u"))
    sure = materialize(pair_links(own.select(F.explode(F.array_distinct("u")).alias("u"), "v"), sets, similarity), "sure")
    label = node.join(components(sure).withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = materialize(label, "labels")
    size = label.groupBy("root", "label").agg(F.count("*").alias("count"), F.sum("n").alias("weight"))
    main = size.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("root", "main")
    split = label.join(materialize(main, "main"), "root").withColumn("other", F.col("label") != F.col("main"))
    held = lambda side: F.ceil(F.greatest(F.lit(1), F.count_if(side) / part, F.sum(F.when(side, F.col("n")).otherwise(0)) / MOST_SHINGLES)).cast("int")
    parts = split.groupBy("root").agg(held(~F.col("other")).alias("p"), held(F.col("other")).alias("q"))
    cells = F.expr("""CASE WHEN other THEN concat(transform(sequence(0, p - 1), i -> xxhash64(root, i, pmod(xxhash64(node), q))),
        transform(filter(sequence(0, q - 1), j -> j <> pmod(xxhash64(node), q)), j -> xxhash64(root, 'others', least(j, pmod(xxhash64(node), q)), greatest(j, pmod(xxhash64(node), q)))))
        ELSE transform(sequence(0, q - 1), j -> xxhash64(root, int(pmod(xxhash64(node), p)), bigint(j))) END""")
    dealt = split.join(materialize(parts, "parts"), "root").select("node", F.explode(cells).alias("bucket")).join(sets.select("node", "shingles"), "node")
    return sure.unionByName(cell_links(dealt, similarity))


def exact_links(keyed: DataFrame, key: str, nodes: DataFrame, pairs: DataFrame, similarity: float, size: int, part: int) -> DataFrame:
    """Edges u, v that connect ``nodes`` as the exact links among those do that ``pairs`` connect; one text of each node is read again."""
    found = components(pairs).join(nodes.select("node", "n", F.col("first_key").alias(key)), "node")
    found = materialize(found, "found")
    large = found.groupBy("root").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).where((F.col("count") > 2 * part) | (F.col("weight") > MOST_SHINGLES))
    large = materialize(large.select("root", F.lit(True).alias("large")), "large")
    wanted = keyed.select(key, "text").join(found.where("n > 0").join(large, "root", "left").hint("merge"), key).select("node", "root", "n", F.coalesce("large", F.lit(False)).alias("large"), "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = pa.array([x.tobytes() for x in shingle_sets(batch.column(4), size)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["node", "root", "n", "large", "shingles"])

    with filtered_joins(keyed.sparkSession):  # few of the texts are wanted
        sets = materialize(map_arrow(wanted, run, "node long, root long, n long, large boolean, shingles binary"), "sets")
    small = cell_links(sets.where("NOT large").withColumnRenamed("root", "bucket"), similarity)
    return small if large.isEmpty() else small.unionByName(large_links(sets.where("large"), pairs, similarity, part))


def similar_rows(keyed: DataFrame, key: str, text_col: str = "text", similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE, part: int = WIDE_PART) -> DataFrame:
    """key, group: the smallest key reachable over pairs of texts whose sets of shingles have ``similarity`` or more.

    key is a column of distinct longs. Texts of one set are one node before any comparison, so copies
    cost no pairs. Sketches only say which texts are compared; every link is an exact Jaccard
    similarity. A pair at exactly 0.8 is compared with probability 0.99998.
    """
    spark = keyed.sparkSession
    keyed = keyed.select(key, F.col(text_col).alias("text"))

    def groups() -> DataFrame:
        sketches = materialize(wide_sketches(keyed, key, size), "sketches")
        nodes = sketches.groupBy("node").agg(F.min(key).alias("first_key"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
        nodes = materialize(nodes, "nodes")
        pairs = materialize(near_pairs(nodes, similarity, part), "pairs")
        links = exact_links(keyed, key, nodes, pairs, similarity, size, part)
        of = _named(nodes.withColumnRenamed("first_key", "first"), components(links), "node")
        return sketches.select(key, "node").join(of, "node").select(key, F.col("component_id").alias("group"))

    return settle(spark, "similar", groups)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE) -> DataFrame:
    """id, component_id: the smallest id reachable over pairs of texts whose sets of shingles have ``similarity`` or more."""
    keyed = with_row_key(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col)
    named = keyed.select("row_key", id_col).join(similar_rows(keyed, "row_key", "text", similarity, size), "row_key")
    lowest = named.groupBy("group").agg(F.min(id_col).alias("component_id"))
    return named.join(lowest, "group").select(id_col, "component_id")
