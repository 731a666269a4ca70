"""Comparison of vectors in tiles and blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.operators import vector_index


def brute(ids, x, query_ids, asked, threshold, limit, others_only):
    sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ asked.T, 6)
    out = set()
    for q, own in enumerate(query_ids):
        pairs = [(-sims[r, q], i) for r, i in enumerate(ids) if sims[r, q] >= threshold and not (others_only and i == own)]
        out |= {(own, i, -s) for s, i in sorted(pairs)[:limit]}
    return out


@pytest.mark.parametrize("tile", [1 << 22, 900])
@pytest.mark.parametrize(("limit", "threshold", "others_only"), [(1, 0.4, True), (3, -1.0, True), (7, 0.1, False)])
def test_tiles_against_brute_force(monkeypatch, tile, limit, threshold, others_only):
    """Copies that tie by similarity, near ties below the digits of single precision, ids as text and out of order."""
    monkeypatch.setattr(vector_index, "TILE", tile)
    pick = np.random.default_rng(3)
    x = pick.standard_normal((300, 16))
    x[40:90] = x[7]
    x[100:140] = x[9] + 1e-7 * pick.standard_normal((40, 16))
    ids = [f"r{k}" for k in pick.permutation(300)]
    asked = vector_index.unit(x[:120])
    r, q, s = vector_index.best_pairs(pa.array(ids), x, pa.array(ids[:120]), asked, threshold, limit, others_only)
    got = {(ids[b], ids[a], c) for a, b, c in zip(r, q, s)}
    assert got == brute(ids, x, ids[:120], asked, threshold, limit, others_only) and len(got) == len(s)


def test_tiles_are_small():
    """Similarities of 4,000 rows and queries are 128 MB in double precision, and were held and sorted several times over."""
    x = np.random.default_rng(3).standard_normal((4000, 16))
    ids = pa.array(range(4000))
    asked = vector_index.unit(x)
    tracemalloc.start()
    vector_index.best_pairs(ids, x, ids, asked, -1.0, 40, True)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_blocks_hold_several_cells(spark, monkeypatch):
    """A query goes once to a block of cells, not to each of its cells; large cells are cut."""
    pick = np.random.default_rng(5)
    x = pick.standard_normal((500, 8))
    x[:200] = x[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    want = brute(range(500), x, range(500), vector_index.unit(x), 0.2, 2, True)
    for part in (64, 2048):
        out = vector_index.match(rows, asked, 0.2, 2, part=part, others_only=True)
        assert {tuple(r) for r in out.collect()} == want


def test_copies_are_held_by_portions(monkeypatch):
    """Where rows are copies of each other, all pairs of a tile are among the best; 4 million were held and sorted at once (over 400 MB)."""
    x = np.tile(np.random.default_rng(3).standard_normal((1, 16)).astype(np.float32), (8192, 1))
    asked = vector_index.unit(x[:512].astype(float))
    ids = pa.array(range(8192, 0, -1))
    tracemalloc.start()
    r, q, s = vector_index.best_pairs(ids, x, ids[:512], asked, -1.0, 3, False)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert q.tolist() == [k for k in range(512) for _ in range(3)] and r.tolist() == [8191, 8190, 8189] * 512 and set(s) == {1.0}


def test_single_precision_is_computed_in_double():
    pick = np.random.default_rng(4)
    x = pick.standard_normal((700, 16)).astype(np.float32)
    x[40:90] = x[7] + 1e-6 * pick.standard_normal((50, 16)).astype(np.float32)
    asked = vector_index.unit(x[:120].astype(float))
    ids = pa.array(range(700))
    r, q, s = vector_index.best_pairs(ids, x, ids[:120], asked, -1.0, 7, True)
    assert {(b, a, c) for a, b, c in zip(r, q, s)} == brute(range(700), x.astype(float), range(120), asked, -1.0, 7, True)


def test_needs_are_told_by_parts(spark):
    """Distances of all queries of a block from all centres were held at once before."""
    part = vector_index.PART
    rows = spark.range(40).selectExpr("id", "array(float(cos(id)), float(sin(id))) AS embedding", "0 AS cell").coalesce(1)
    asked = spark.range(part + 300).selectExpr("id AS query_id", "array(float(cos(id)), float(sin(id))) AS query_embedding").coalesce(1)

    def needs(vectors):
        assert len(vectors) <= part
        return np.ones((len(vectors), 1), bool)

    got = vector_index.whole_cells(rows, asked, {0: 40}, needs, -1.0, 1, part=2 * part).collect()
    assert len(got) == part + 300 and all(r.id == r.query_id for r in got if r.query_id < 40)
