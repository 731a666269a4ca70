"""Vector codes: each vector becomes the numbers of its nearest codebook entries, part by part.

Codebooks are fitted over all rows by rounds of assignment and means, in integers throughout. Nearest entries are found in
a ball tree over the entries of a part position: a ball is left out only if the distance to its centre, less its radius,
is above the best distance so far. Distances are rounded down and radii and best distances up (whole square roots), balls
that might tie are visited, and squared integer distances decide in the leaves.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are rows whose
vector is not as long as that of the first seed; a length that is no multiple of the parts is filled up with zeros; a null
id never is a seed but is coded (without any other, the smallest vector is the one seed); of equal ids the smaller vector comes first; fewer rows than entries give fewer entries;
equal rows each get their own result; an empty table gives an empty result; other columns are left alone. Components may
be as large as a double: where squares could pass 64 bits, the same steps run on whole numbers of any size, and an error
above the largest long is given as that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from engram.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of the tree, and points searched at once.
LEAF, SLICE = 8, 4096
#: Sums too large for a long travel in limbs of so many bits.
LIMB = 30
_LARGEST = (1 << 63) - 1
_big_root = np.frompyfunc(math.isqrt, 1, 1)


def root_down(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    if squares.dtype == object:
        return _big_root(squares) if len(squares) else squares
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    gap = points - entry
    return (gap * gap).sum(axis=-1)


def narrow(rows: np.ndarray) -> np.ndarray:
    """Integers as int64 where squared distances of their size fit, else as whole numbers of any size."""
    if not rows.size:
        return rows.astype(np.int64)
    most = max(abs(int(rows.max())), abs(int(rows.min())))
    return rows.astype(np.int64 if 4 * rows.shape[-1] * most * most < 1 << 62 else object)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exactly."""
    if not values.size or np.abs(values).max() < 2.0**40:  # a product with a power of two is exact
        return np.floor(values * SCALE).astype(np.int64)
    out = np.empty(values.shape, object)
    out.flat = [math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in values.ravel().tolist()]
    return out


class BallTree:
    """The distinct entries of one part position; of equal ones the lowest index, as the others never win."""

    def __init__(self, entries: np.ndarray):
        first: dict[tuple, int] = {}
        for i, entry in enumerate(entries.tolist()):
            first.setdefault(tuple(entry), i)
        self.entries = entries
        #: centre, radius, members (of a leaf) or None, left and right (places in this list)
        self.nodes: list[tuple] = []
        self._add(np.array(sorted(first.values()), np.int64))

    def _add(self, members: np.ndarray) -> int:
        place = len(self.nodes)
        own = self.entries[members]
        centre = own.sum(axis=0) // len(members)
        away = squared(own, centre)
        radius = int(root_down(away[[int(away.argmax())]])[0]) + 1
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[place] = (centre, radius, members, -1, -1)
            return place
        a = own[int(away.argmax())]
        from_a = squared(own, a)
        nearer_b = squared(own, own[int(from_a.argmax())]) < from_a
        left, right = self._add(members[~nearer_b]), self._add(members[nearer_b])
        self.nodes[place] = (centre, radius, None, left, right)
        return place

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (ties to the lower) and squared distance of the nearest entry of each point."""
        n = len(points)
        index, best = np.full(n, -1, np.int64), np.zeros(n, points.dtype)
        # straight down to a leaf for a first bound
        todo = [(0, np.arange(n))]
        while todo:
            place, who = todo.pop()
            if not len(who):
                continue
            _, _, members, left, right = self.nodes[place]
            if members is not None:
                self._verify(points, members, who, index, best)
                continue
            nearer = squared(points[who], self.nodes[left][0]) <= squared(points[who], self.nodes[right][0])
            todo += [(left, who[nearer]), (right, who[~nearer])]
        # then every ball that may hold as near a one
        todo = [(0, np.arange(n))]
        while todo:
            place, who = todo.pop()
            centre, radius, members, left, right = self.nodes[place]
            who = who[root_down(squared(points[who], centre)) - radius <= root_down(best[who]) + 1]
            if len(who) and members is not None:
                self._verify(points, members, who, index, best)
            elif len(who):
                todo += [(right, who), (left, who)]
        return index, best

    def _verify(self, points: np.ndarray, members: np.ndarray, who: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        away = squared(points[who][:, None, :], self.entries[members])
        at = away.argmin(axis=1)  # members ascend, so ties go to the lower index
        away, found = away[np.arange(len(who)), at], members[at]
        better = (index[who] < 0) | (away < best[who]) | ((away == best[who]) & (found < index[who]))
        index[who[better]], best[who[better]] = found[better], away[better]


def assign(points: np.ndarray, trees: list[BallTree]) -> tuple[np.ndarray, np.ndarray]:
    """For points (n, parts, width) the indexes and squared distances (n, parts)."""
    index, away = np.empty(points.shape[:2], np.int64), np.empty(points.shape[:2], points.dtype)
    for a in range(0, len(points), SLICE):
        for p, tree in enumerate(trees):
            index[a : a + SLICE, p], away[a : a + SLICE, p] = tree.nearest(points[a : a + SLICE, p])
    return index, away


def kept_rows(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is whole and finite."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.withColumn(vector_col, v).where(F.col(vector_col).isNotNull() & whole)


def points_of(batch: pa.RecordBatch, length: int, parts: int) -> np.ndarray:
    """Integer parts (n, parts, width) of a batch's vectors, all of this length."""
    flat = integers(batch.column(0).flatten().to_numpy(zero_copy_only=False))
    rows = flat.reshape(batch.num_rows, length)
    filled = -length % parts
    if filled:
        rows = np.concatenate([rows, np.zeros((len(rows), filled), rows.dtype)], axis=1)
    return narrow(rows.reshape(len(rows), parts, -1))


class Search:
    """The trees of a task, built once for each kind of integer."""

    def __init__(self, codebooks: list[np.ndarray]):
        most = narrow(np.concatenate(codebooks))
        self.codebooks, self.kind, self.trees = codebooks, most.dtype, {}

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = np.dtype(object) if object in (points.dtype, self.kind) else np.dtype(np.int64)
        if kind not in self.trees:
            self.trees[kind] = [BallTree(c.astype(kind)) for c in self.codebooks]
        points = points.astype(kind)
        return (points, *assign(points, self.trees[kind]))


def first_codebooks(kept: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> tuple[int, list[np.ndarray]]:
    """The vectors' length, and a codebook for each part from the rows with the smallest ids. So many rows come to the driver."""
    some = kept.where(F.col(id_col).isNotNull())
    first = some.orderBy(id_col, vector_col).select(vector_col).first() or kept.orderBy(vector_col).select(vector_col).first()
    if first is None:
        return 0, []
    length = len(first[0])
    if not length:
        return 0, []
    seeds = some.where(F.size(vector_col) == length).orderBy(id_col, vector_col).select(vector_col).limit(entries).collect()
    values = np.array([r[0] for r in seeds or [first]], np.float64).reshape(-1, length)
    batch = pa.RecordBatch.from_arrays([pa.array(values.tolist(), pa.list_(pa.float64()))], names=["v"])
    points = points_of(batch, length, parts)
    return length, [points[:, p] for p in range(parts)]


def better_codebooks(spark: SparkSession, vectors: DataFrame, length: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round over all rows: every entry becomes the floor of the mean of the parts assigned to it.

    A task adds up what its rows give each entry and hands on one row for each entry and component; Spark adds those up.
    What comes to the driver is as large as the codebooks.
    """
    parts, (entries, width) = len(codebooks), codebooks[0].shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(codebooks)
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                points, index, _ = search(points_of(batch, length, parts))
                slots = (index + np.arange(parts) * entries).ravel()
                if points.dtype == object:
                    sums = sums.astype(object)
                np.add.at(sums, slots, points.reshape(-1, width))
                counts += np.bincount(slots, minlength=len(counts))
        used = np.flatnonzero(counts)
        slots, places = np.repeat(used, width + 1), np.tile(np.arange(width + 1), len(used))
        totals = np.concatenate([sums[used], counts[used, None]], axis=1).ravel()
        limb = 0
        while len(totals):
            # the last limb is what is left, with its sign
            rest = totals >> LIMB if totals.dtype == object else np.zeros(0, np.int64)
            more = np.array([not -(1 << 45) < x < 1 << 45 for x in totals], bool) if len(rest) else np.zeros(len(totals), bool)
            now = np.where(more, totals & ((1 << LIMB) - 1), totals) if len(rest) else totals
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int64()), pa.array(places, pa.int64()), pa.array(np.full(len(now), limb), pa.int64()), pa.array(now.astype(np.int64), pa.int64())], names=["slot", "place", "limb", "total"]
            )
            slots, places, totals, limb = slots[more], places[more], (rest[more] if len(rest) else totals[more]), limb + 1

    sums = vectors.mapInArrow(add_up, "slot long, place long, limb long, total long").groupBy("slot", "place", "limb").agg(F.sum("total").alias("total"))
    found: dict[int, list[int]] = {}
    for r in sums.collect():  # as many rows as the codebooks have components (times limbs)
        found.setdefault(r.slot, [0] * (width + 1))[r.place] += r.total << (LIMB * r.limb)
    out = [c.astype(object) for c in codebooks]
    for slot, totals in found.items():
        out[slot // entries][slot % entries] = [x // totals[-1] for x in totals[:-1]]
    return [narrow(c) for c in out]


def encode_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error of every kept row; the final codebooks, one integer array for each part)."""
    if not 0 < entries <= 256:
        raise ValueError("an index must fit two hex digits")
    spark = rows.sparkSession
    kept = kept_rows(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")), "v")
    length, codebooks = first_codebooks(kept, "id", "v", parts, entries)
    fits = kept.where(F.size("v") == length)
    for _ in range(rounds if length else 0):
        codebooks = better_codebooks(spark, fits.select("v"), length, codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if length:
                search = search or Search(codebooks)
                _, index, away = search(points_of(batch, length, parts))
                digits = index.astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                errors = [min(_LARGEST, int(x)) for x in away.sum(axis=1)]
            else:
                codes, errors = ["00" * parts] * batch.num_rows, [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    schema = StructType([kept.schema["id"], kept.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return fits.select("v", "id", "label").mapInArrow(code, schema), codebooks


def compress_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **sizes: int) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 and label of every kept row."""
    coded, codebooks = encode_vectors(rows, id_col, vector_col, label_col, **sizes)
    coded = materialize(coded, "coded")
    said = ",".join(str(x) for c in codebooks for x in c.ravel().tolist())
    digest = hashlib.sha256(said.encode()).hexdigest()
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy(F.col("label").alias("its_label")).agg(F.least(wide, F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("label").alias(label_col))
