"""Vectors in cells around centroids: exact matches between two large sets, and a kept index for approximate neighbours.

Centroids are fitted on a bounded sample (SAMPLE rows by a hash of the id); every row then goes to the cell of its nearest one. Cells
are cut into parts of bounded size, and rows and queries of a cell meet part by part in one job, so neither a hot cell nor a large
set of queries lands in one task or on the driver.

The index keeps a sketch of every row (the sides of SKETCH random planes that its vector lies on). A query looks into the lists of
its nearest centroids, and compares vectors with those rows only whose sketch differs in few bits. How many lists it looks into
and how many bits may differ is measured when the index is built: so many that the sample's own neighbours pass (RECALL). Where
vectors lie in clusters that is few lists; where they point in all directions alike, no lists rule out many, and the sketches do.

Defined results: rows and queries whose vector is null, of length zero or not finite are left out; ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import ranking, vector
from engram.operators.filters import best_per, top
from engram.storage import materialize, new_folder

#: Rows that centroids are fitted on, centroids at most (and no more than the root of the sample), rounds of fitting.
SAMPLE, CELLS, ROUNDS = 8192, 256, 8
#: Rows and queries that meet at once.
PART = 2048
#: Rows and queries that meet at once on large tables, at most: what moves is the product of both sides by this.
MOST_PART = 65_536
#: Similarities in a tile, pairs that are computed in full at once, and pairs of a tile that are held and sorted at once (a query's stay together).
TILE, _PAIRS, _HELD = 1 << 22, 1 << 14, 1 << 18
#: What rounding of similarities to six digits may hide, and of distances.
_SLACK, _NEAR = 1e-6, 1e-9
#: Bits of a sketch, share of the sample's neighbours that must pass (by lists and by sketches), and how many rows and neighbours tell it.
SKETCH, RECALL, ASKED, NEIGHBOURS = 512, 0.97, 256, 10
#: Rows by similarity that are ranked again for each row wanted.
POOL = 4


def matrix(column: pa.Array, kind: type | None = np.float64) -> np.ndarray:
    """Rows of a column of equally long lists; without a kind in single precision where they came so, and not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if kind is None:
        kind = np.float32 if values.dtype == np.float32 else np.float64
    return values.astype(kind, copy=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction."""
    size = vector.norm(F.col(embedding))
    return rows.where(F.col(embedding).isNotNull() & (size > 0) & (size < float("inf")))


def sampled(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of ``sample`` rows at most, chosen by a hash of the id."""
    some = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    return unit(np.array([r.embedding for r in some], np.float64)) if some else np.zeros((0, 0))


def fit(x: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Centroids of a sample of unit vectors."""
    if not len(x):
        return x
    centres = x[: max(1, min(cells, math.isqrt(len(x))))].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        for k in np.unique(own):
            centres[k] = x[own == k].mean(axis=0)
    return centres


def measured(x: np.ndarray, centres: np.ndarray) -> tuple[int, int]:
    """The least number of lists, and of bits by which sketches differ, that let nearly all neighbours within a sample pass."""
    if not len(x):
        return 1, 0
    near = np.argsort(-(x[:ASKED] @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    away = distances(x, centres)
    turn = np.argsort(np.argsort(away[:ASKED], axis=1, kind="stable"), axis=1)  # how many lists are nearer to a query than each
    lists = np.take_along_axis(turn, away.argmin(axis=1)[near], axis=1)
    own = sketches(x)
    flips = np.bitwise_count(own[:ASKED, None, :] ^ own[near]).sum(axis=2)
    at = math.ceil(RECALL * near.size) - 1
    return int(np.sort(lists.ravel())[at]) + 1, int(np.sort(flips.ravel())[at])


def sketches(x: np.ndarray) -> np.ndarray:
    """The sides of SKETCH random planes, always the same ones, that vectors lie on: (n, SKETCH / 64) words of bits."""
    planes = np.random.default_rng(42).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ planes > 0, axis=1).view(np.uint64)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (with a column embedding) with the nearest cell, the distance from its centre and the sketch."""
    at, names = rows.columns.index("embedding"), [*rows.columns, "cell", "away", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                own = batch.slice(a, PART)
                x = unit(matrix(own.column(at)))
                away = distances(x, centres)
                cell = away.argmin(axis=1)
                columns = [*own.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), pa.array(list(sketches(x).view(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, unplaced(rows.limit(0)).schema)


def unplaced(rows: DataFrame) -> DataFrame:
    """``rows`` in one cell of their own."""
    return rows.withColumn("cell", F.lit(0)).withColumn("away", F.lit(0.0)).withColumn("sketch", F.array().cast("array<long>"))


def to_cells(queries: DataFrame, centres: np.ndarray, probes: int | None = None, radii: np.ndarray | None = None, reach: float = 0.0) -> DataFrame:
    """query_id, query_embedding and cell of the ``probes`` nearest cells, or of all that may hold a vector within ``reach``.

    A vector of a cell is within its radius of the centre, so by the triangle inequality a cell is ruled out where the query's
    distance from the centre, less the radius, is above the reach. The radius of a cell without rows is negative infinity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                own = batch.slice(a, PART)
                away = distances(unit(matrix(own.column(1))), centres)
                if probes is not None:
                    cell = np.argsort(away, axis=1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(len(cell)), cell.shape[1])
                    cell = cell.ravel()
                else:
                    row, cell = np.nonzero(away - radii <= reach + _NEAR)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in own.columns), pa.array(cell.astype(np.int32))], names=["query_id", "query_embedding", "cell"])

    asked = queries.select("query_id", "query_embedding")
    return asked.mapInArrow(run, asked.limit(0).withColumn("cell", F.lit(0)).schema)


def by_sketch(x: np.ndarray, own: np.ndarray, asked: np.ndarray, flips: int) -> np.ndarray:
    """For rows, their sketches and unit query vectors the similarities of pairs whose sketches differ in so few bits; -2 for the others."""
    theirs, rows, sims = sketches(asked), unit(x), np.full((len(x), len(asked)), -2.0)
    for a in range(0, len(asked), 64):
        differ = sum(np.bitwise_count(own[:, None, k] ^ theirs[None, a : a + 64, k]).astype(np.int32) for k in range(own.shape[1]))
        r, q = np.nonzero(differ <= flips)
        sims[r, a + q] = np.round(np.einsum("ij,ij->i", rows[r], asked[a + q]), 6)
    return sims


def best_pairs(ids: pa.Array, x: np.ndarray, query_ids: pa.Array, asked: np.ndarray, threshold: float, limit: int, others_only: bool, sims: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows and unit query vectors: places of row and query and the similarity, ``limit`` a query, by similarity and id.

    Tiles of similarities in single precision tell which pairs may be among the best; only those are computed in full and sorted.
    """
    by_id = pc.sort_indices(ids).to_numpy()
    norms, light = np.empty(len(x)), np.empty(x.shape, np.float32)  # in the order of ids
    for a in range(0, len(x), PART):
        own = x[by_id[a : a + PART]].astype(np.float64, copy=False)
        norms[a : a + PART] = np.linalg.norm(own, axis=1)
        light[a : a + PART] = own / norms[a : a + PART, None]
    own_q, own_r = own_pairs(ids.take(pa.array(by_id)), query_ids) if others_only else (np.zeros(0, np.int64),) * 2
    slack = 2 * _SLACK + 2 * (x.shape[1] + 4) * 2.0**-24  # rounding to six digits, and both errors of single precision
    groups = max(1, min(len(ids), max(1024, 8 * limit)))
    whole = len(ids) // groups * groups
    out, step = [], max(1, min(len(asked), TILE // max(1, len(ids))))
    tile, flags = np.empty((step, len(ids)), np.float32), np.empty((step, len(ids)), bool)  # used again and again
    for a in range(0, len(asked), step):
        mine = slice(*np.searchsorted(own_q, (a, a + step)))
        if sims is None:
            near = np.matmul(asked[a : a + step].astype(np.float32), light.T, out=tile[: len(asked) - a])
            near[own_q[mine] - a, own_r[mine]] = -2
            # so many groups have a best row at or above it, so the last of the best is there or higher
            tops = near[:, :whole].reshape(len(near), -1, groups).max(axis=1)
            floor = np.partition(tops, groups - limit, axis=1)[:, groups - limit] if groups > limit else np.full(len(near), -2.0)
            floor = np.maximum(np.maximum(floor, threshold) - slack, -1.5).astype(np.float32)
            able = np.greater_equal(near, floor[:, None], out=flags[: len(near)])
        else:
            near = sims[by_id, a : a + step].T.copy()
            near[own_q[mine] - a, own_r[mine]] = -2
            able = near >= threshold
        counts = np.count_nonzero(able, axis=1)
        starts = np.flatnonzero(np.diff((np.cumsum(counts) - counts) // _HELD, prepend=-1))  # copies may all be among the best
        for lo, hi in zip(starts, [*starts[1:], len(able)]):
            q, r = np.divmod(np.flatnonzero(able[lo:hi].ravel()), len(ids))
            q += lo
            if sims is None:
                told = [np.einsum("ij,ij->i", x[by_id[r[k : k + _PAIRS]]].astype(np.float64, copy=False), asked[a + q[k : k + _PAIRS]]) / norms[r[k : k + _PAIRS]] for k in range(0, len(q), _PAIRS)]
                exact = np.round(np.concatenate(told), 6) if told else np.zeros(0)
            else:
                exact = near[q, r]
            keep = exact >= threshold
            q, r, exact = first_of(q[keep], r[keep], exact[keep], limit)
            out.append((by_id[r].astype(np.int32), (a + q).astype(np.int32), exact))
    r, q, exact = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return r, q, exact


def first_of(q: np.ndarray, turn: np.ndarray, sims: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``limit`` pairs of each query, by similarity and turn."""
    order = np.lexsort((turn, -sims, q))
    q, turn, sims = q[order], turn[order], sims[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < limit
    return q[first], turn[first], sims[first]


def own_pairs(ids: pa.Array, query_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries, in order, and of the rows that have the query's id."""
    place: dict[object, list[int]] = {}
    for i, v in enumerate(ids.to_pylist()):
        place.setdefault(v, []).append(i)
    pairs = [(q, r) for q, v in enumerate(query_ids.to_pylist()) for r in place.get(v, ())]
    return (np.array([q for q, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))


def compare(lists: DataFrame, asked: DataFrame, threshold: float, limit: int, part: int = PART, others_only: bool = False, flips: int | None = None, tally: bool = False) -> DataFrame:
    """query_id, id, similarity of rows (cell, id, embedding, sketch) and queries (cell, query_id, query_embedding) that meet in a cell.

    A cell's rows and queries are dealt to parts of about ``part``; each part of the one meets each part of the other once, and gives
    ``limit`` rows a query at most. With ``flips`` only rows whose sketch differs in so few bits are compared. ``tally`` gives query_id and
    compared instead, the number of rows of a part that a query was compared with.
    """
    sizes = lists.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    turns = asked.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("turns"))
    cells = F.broadcast(materialize(sizes.join(turns, "cell"), "cells"))  # CELLS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = ["id", "embedding"] + ([] if flips is None else ["sketch"])
    left = lists.select("cell", *told).join(cells, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"), every("turns").alias("j"), *told)
    right = asked.join(cells, "cell").select("cell", every("parts").alias("i"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("j"), "query_id", "query_embedding")
    schema = asked.select("query_id").join(lists.select("id")).limit(0).withColumn("similarity", F.lit(0.0)).schema
    if tally:
        schema = asked.select("query_id").limit(0).withColumn("compared", F.lit(0).cast("long")).schema

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids = rows["id"].combine_chunks(), queries["query_id"].combine_chunks()
        if tally:
            sims = by_sketch(matrix(rows["embedding"]), matrix(rows["sketch"], np.int64).view(np.uint64), unit(matrix(queries["query_embedding"])), flips) if len(ids) and len(query_ids) else np.zeros((0, len(query_ids)))
            return pa.table([query_ids, pa.array((sims > -2).sum(axis=0), pa.int64())], names=["query_id", "compared"])
        if not len(ids) or not len(query_ids):
            return pa.table([query_ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=["query_id", "id", "similarity"])
        x, asked = matrix(rows["embedding"]), unit(matrix(queries["query_embedding"]))
        sims = None if flips is None else by_sketch(x, matrix(rows["sketch"], np.int64).view(np.uint64), asked, flips)
        r, q, sims = best_pairs(ids, x, query_ids, asked, threshold, limit, others_only, sims)
        return pa.table([query_ids.take(pa.array(q)), ids.take(pa.array(r)), pa.array(sims)], names=["query_id", "id", "similarity"])

    key = ("cell", "i", "j")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def whole_cells(lists: DataFrame, queries: DataFrame, counts: dict[int, int], needs: Callable[[np.ndarray], np.ndarray], threshold: float, limit: int, part: int = PART, others_only: bool = False) -> DataFrame:
    """query_id, id, similarity: each query against all rows of the cells that it needs (a row of flags for a unit vector).

    Cells lie in blocks of some ``part`` rows, or a sixth of all up to MOST_PART where that is more; a larger cell is dealt to several.
    A query goes once to each block with a cell that it needs. So what moves grows with the number of blocks, not of cells.
    """
    spark, total, asked_total = lists.sparkSession, sum(counts.values()), queries.count()
    room = lambda n: min(max(MOST_PART, part), max(part, math.ceil(n / 6)))
    size, turns = room(total), max(1, math.ceil(asked_total / room(asked_total)))
    places, at, held, members = [], 0, 0, [[]]
    for cell, n in sorted(counts.items()):
        if held and held + n > size:
            at, held = len(members), 0
            members.append([])
        split = max(1, math.ceil(n / size))
        places.append((cell, at, split))
        members[at].append(cell)
        for _ in range(split - 1):
            members.append([cell])
        held = size if split > 1 else held + n
    dealt = spark.createDataFrame(places, "cell int, first int, split int")  # a row a cell
    left = lists.select(F.col("cell").cast("int").alias("cell"), "id", "embedding").join(F.broadcast(dealt), "cell")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("split")).cast("int")
    left = left.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "cell", "id", "embedding")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                own = batch.slice(a, PART)
                flags = needs(unit(matrix(own.column(1))))
                for k, cells in enumerate(members):
                    some = own.filter(pa.array(flags[:, cells].any(axis=1)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, k, np.int32))], names=["query_id", "query_embedding", "block"])

    asked = queries.select("query_id", "query_embedding")
    right = asked.mapInArrow(to_blocks, asked.limit(0).withColumn("block", F.lit(0)).schema).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    schema = asked.select("query_id").join(lists.select("id")).limit(0).withColumn("similarity", F.lit(0.0)).schema

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids = rows["id"].combine_chunks(), queries["query_id"].combine_chunks()
        if not len(ids) or not len(query_ids):
            return pa.table([query_ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=["query_id", "id", "similarity"])
        x, asked, cell = matrix(rows["embedding"], None), unit(matrix(queries["query_embedding"])), rows["cell"].to_numpy()
        flags, found = np.concatenate([needs(asked[a : a + PART]) for a in range(0, len(asked), PART)]), []
        common = np.array([c for c in np.unique(cell) if flags[:, c].all()], np.int64)  # cells that all need are taken together
        for own in [common, *([c] for c in np.setdiff1d(np.unique(cell), common))]:
            r, q = np.flatnonzero(np.isin(cell, own)), np.flatnonzero(flags[:, own].all(axis=1)) if len(own) else np.zeros(0, np.int64)
            if len(r) and len(q):
                some = x if len(r) == len(x) else x[r]
                i, j, sims = best_pairs(ids.take(pa.array(r)), some, query_ids.take(pa.array(q)), asked if len(q) == len(asked) else asked[q], threshold, limit, others_only)
                found.append((q.astype(np.int32)[j], r.astype(np.int32)[i], sims))
        q, r, sims = found[0] if len(found) == 1 else (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(found) > 1:
            back = pc.sort_indices(ids).to_numpy()
            turn = np.empty_like(back)
            turn[back] = np.arange(len(back))
            q, t, sims = first_of(q, turn[r], sims, limit)
            r = back[t]
        return pa.table([query_ids.take(pa.array(q)), ids.take(pa.array(r)), pa.array(sims)], names=["query_id", "id", "similarity"])

    tasks, key = min(4 * len(members) * turns, 2000), ("block", "turn")
    return left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(meet, schema)


def match(rows: DataFrame, queries: DataFrame, threshold: float, limit: int = 1, part: int = PART, others_only: bool = False) -> DataFrame:
    """The nearest rows (query_id, id, similarity) at or above a similarity of every query, exactly, however many queries there are.

    The number of jobs is the same for any two sets. What the threshold leaves of the cells depends on the data: with a low one
    every row is compared with every query, in parts.
    """
    able = usable(rows.select("id", "embedding"))
    centres = fit(sampled(able))
    asked = usable(queries.select("query_id", "query_embedding"), "query_embedding")
    if not len(centres):
        return asked.select("query_id").join(able.select("id")).limit(0).withColumn("similarity", F.lit(0.0))
    lists = materialize(placed(able, centres).drop("sketch"), "lists")
    radii, counts = np.full(len(centres), -np.inf), {}
    for r in lists.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radii[r.cell], counts[r.cell] = r.r, r.n
    reach = math.sqrt(max(0.0, 2 - 2 * (threshold - _SLACK)))
    needs = lambda asked: distances(asked, centres) - radii <= reach + _NEAR
    found = whole_cells(lists, asked, counts, needs, threshold, limit, part, others_only)
    return best_per(found, "query_id", F.desc("similarity"), F.asc("id"), limit=limit)


@dataclass
class Index:
    """Lists of rows by cell under a folder, the centroids, how many lists a query looks into, and by how many bits sketches may differ."""

    path: str
    centres: np.ndarray
    probes: int
    flips: int

    def lists(self, spark: SparkSession) -> DataFrame:
        shape = spark.read.parquet(f"{self.path}/shape").schema  # also where there are no rows
        return spark.read.schema(shape).parquet(f"{self.path}/lists")


def build(rows: DataFrame, path: str | None = None, sample: int = SAMPLE, cells: int = CELLS) -> Index:
    """Write every row (id, embedding and what else it has) to the list of its nearest centroid.

    Centroids are fitted on ``sample`` rows; the lists hold all. Spark splits large lists into several files and joins small ones.
    """
    spark = rows.sparkSession
    path = path or new_folder(spark, "index")
    x = sampled(usable(rows), sample)
    centres = fit(x, cells)
    index = Index(path, centres, *measured(x, centres))
    numbered = [(k, [float(v) for v in c], index.probes, index.flips) for k, c in enumerate(centres)]
    spark.createDataFrame(numbered, "cell int, centre array<double>, probes int, flips int").write.parquet(f"{path}/centres")
    unplaced(rows.limit(0)).write.parquet(f"{path}/shape")
    add(index, rows, "error")
    return index


def add(index: Index, rows: DataFrame, mode: str = "append") -> None:
    """Put more rows into the lists of an index; its centroids stay."""
    able = usable(rows)
    found = placed(able, index.centres) if len(index.centres) else unplaced(able)
    found.hint("rebalance", "cell").write.partitionBy("cell").mode(mode).parquet(f"{index.path}/lists")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS rows at most
    return Index(path, np.array([r.centre for r in rows], np.float64).reshape(len(rows), -1), *((rows[0].probes, rows[0].flips) if rows else (1, 0)))


def compared_share(index: Index, queries: DataFrame, probes: int | None = None) -> float:
    """Vectors compared by all queries together, as a share of queries times rows."""
    lists = index.lists(queries.sparkSession)
    asked = materialize(to_cells(usable(queries, "query_embedding"), index.centres, probes or index.probes), "asked")
    total = compare(lists, asked, -1.0, 1, flips=index.flips, tally=True).agg(F.sum("compared")).first()[0] or 0
    return total / max(1, queries.count() * lists.count())


def search(index: Index, queries: DataFrame, limit: int = 25, probes: int | None = None, every: bool = False, others_only: bool = False) -> DataFrame:
    """The nearest rows (query_id, id, similarity) of each query among the lists that it looks into; ``every`` compares all of their rows."""
    spark = queries.sparkSession
    if not len(index.centres):
        return match(index.lists(spark), queries, -1.0, limit, others_only=others_only)
    lists, able, centres, probes = index.lists(spark), usable(queries, "query_embedding"), index.centres, probes or index.probes
    if every:
        counts = {r.cell: r["count"] for r in lists.groupBy("cell").count().collect()}  # a row a cell

        def needs(asked: np.ndarray) -> np.ndarray:
            flags = np.zeros((len(asked), len(centres)), bool)
            np.put_along_axis(flags, np.argsort(distances(asked, centres), axis=1, kind="stable")[:, :probes], True, axis=1)
            return flags

        found = whole_cells(lists, able, counts, needs, -1.0, limit, others_only=others_only)
    else:
        found = compare(lists, materialize(to_cells(able, centres, probes), "asked"), -1.0, limit, others_only=others_only, flips=index.flips)
    return best_per(found, "query_id", F.desc("similarity"), F.asc("id"), limit=limit)


def search_ranked(index: Index, queries: DataFrame, now: datetime, limit: int = 25, probes: int | None = None, every: bool = False, pool: int = POOL, others_only: bool = False) -> DataFrame:
    """Two stages: the ``pool * limit`` nearest rows of each query by similarity, then the best of them by similarity and recency.

    The lists must have created_at and type. query_id, id, similarity (of six digits) and score (of eight).
    """
    found = search(index, queries, pool * limit, probes, every, others_only)
    facts = index.lists(queries.sparkSession).select("id", "created_at", "type")
    recency = ranking.recency_calendar(F.col("created_at"), F.lit(now).cast("timestamp_ntz"), F.col("type"))
    scored = found.join(facts, "id").select("query_id", "id", "similarity", F.round(ranking.page_score(F.col("similarity"), recency), 8).alias("score"))
    return best_per(scored, "query_id", F.desc("score"), F.asc("id"), limit=limit)


def nearest(index: Index, spark: SparkSession, query: Sequence[float], limit: int = 25, probes: int | None = None) -> DataFrame:
    """The page of one query: its nearest lists are known here, so that no other is read."""
    lists = index.lists(spark)
    if len(index.centres):
        away = distances(unit(np.array([query], np.float64)), index.centres)[0]
        cells = np.argsort(away, kind="stable")[: probes or index.probes]
        lists = lists.where(F.col("cell").isin([int(c) for c in cells]))
    scored = lists.withColumn("similarity", F.round(vector.cosine_to(F.col("embedding"), query), 6))
    return top(scored.drop("cell", "away", "sketch"), F.desc("similarity"), F.asc("id"), limit=limit)
