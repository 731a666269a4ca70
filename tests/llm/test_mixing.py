"""Mixing, spelling variants and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import mixing, queries, spelling, vector_codes

from .fixtures import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_brute(rows, weights=(5, 2, 1), epochs=3):
    """(id, size, source_size, target, taken) of rows (id, text, source), counted in the order of the keys."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(total.values()) - sum(epochs * total[s] for s in stopped)
        among = sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and Fraction(left * weight[s], among) > epochs * total[s]}
        if not more:
            break
        stopped |= more
    target = {s: float(epochs * total[s]) if s in stopped else left * weight[s] / among for s in order}

    def key(i):
        d, t, _ = rows[i]
        return hashlib.md5(":".join(x for x in ("mix", None if d is None else str(d), t) if x is not None).encode()).hexdigest()[:16]

    used, out = Counter(), []
    for i in sorted(range(len(rows)), key=lambda i: (key(i), -1 if rows[i][0] is None else rows[i][0], size[i])):
        s = rows[i][2]
        budget = math.floor(target[s] + 0.5)
        whole = budget // total[s] if total[s] else 0
        part = max(0, min(size[i], budget - whole * total[s] - used[s]))
        used[s] += size[i]
        out.append((rows[i][0], size[i], total[s], target[s], whole * size[i] + part))
    return Counter(out)


def mixed(df, **more):
    return Counter((r[0], r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df, **more).collect())


def test_mix_awkward(spark):
    rows = [tuple(r) for r in awkward(spark).select("doc_id", "text", "source").collect()]
    assert mixed(awkward(spark)) == mixed_brute(rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_sources(spark):
    """Hot, tiny, empty and null sources; one source alone; other weights; the order of rows and parts does not matter."""
    r = random.Random(3)
    pool = ["hot"] * 30 + ["a", "b", "B", "é", "", None] + ["none"] * 2
    rows = [(i if r.random() < 0.9 else None, "" if (s := r.choice(pool)) == "none" else " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 60))), s) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixed_brute(rows)
    assert mixed(df.repartition(5)) == want == mixed(df.orderBy(F.desc("doc_id")).coalesce(1))
    totals = {(x.source, x.target): 0 for x in mixing.mix(df).collect()}
    for x in mixing.mix(df).collect():
        totals[x.source, x.target] += x.taken
        assert x.taken <= 3 * x.size
    assert all(n == math.floor(t + 0.5) for (_, t), n in totals.items())
    assert mixed(df, weights=(1, 7), most_epochs=2) == mixed_brute(rows, (1, 7), 2)
    one = df.where("source = 'hot'")
    assert all(x.taken == x.size for x in mixing.mix(one).collect())


def test_sums_before_spans_parts(spark):
    df = spark.range(5000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("g"), F.col("id").alias("v"))
    got = mixing.sums_before(df, "g", [F.col("v")], ["v"]).collect()
    run = Counter()
    for g, v, before in sorted((r.g, r.v, r.before_v) for r in got):
        assert before == run[g]
        run[g] += v


def test_mix_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    assert mixed(queries.table(spark, sf_dir, "documents")) == mixed_brute(rows)


def variants_brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((len(w), i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for group in holes.values():  # replaced at one place
        for w in group:
            near[w] |= {x for x in group if x != w}
    for w in n:  # one deleted
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def variants(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect())


def test_variants_awkward(spark):
    rows = [tuple(r) for r in awkward(spark).select("doc_id", "text").collect()]
    got = variants(awkward(spark))
    assert got == variants_brute(rows) and len(got) == 5
    assert spelling.group_variants(empty(spark)).count() == 0


def test_variants_random(spark, monkeypatch):
    """Chains, ties and words of few letters, so that near words abound; every kind of edit in all bands."""
    r = random.Random(8)
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = list(r.choice(["banana", "cabbage", "letters", "größere", "Ünïcode", "aaaaaaa", "spelling"]))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice(["", "a", "b", "é", "×"])
            words += ["".join(w)] * r.choice([1, 1, 3])
        rows.append((i, r.choice([" ", "-", "1"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants(df)
    assert got == variants_brute(rows)
    assert len([x for x in got if x[1] and x[2] != x[1]]) > 3
    many = df.union(df).union(df.selectExpr("doc_id + 1", "text")).repartition(3)
    assert variants(many) == variants_brute([*rows, *rows, *((i + 1, t) for i, t in rows)])


def test_cells(spark, monkeypatch):
    """Cells of a few words each, whose pairs lie over all of them."""
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(5, 8))) for _ in range(600)}
    rows = [(i, " ".join([w] * r.randrange(3, 9))) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = variants_brute(rows)
    monkeypatch.setattr(spelling, "CELL_LETTERS", 1 << 13)
    assert variants(df) == want and len(want) > 300
    monkeypatch.setattr(spelling, "_PAIRS", 5)
    assert variants(df.where("doc_id < 60")) == variants_brute(rows[:60])


def test_counts_are_handed_on(spark, monkeypatch):
    docs = awkward(spark)
    want = Counter(map(tuple, spelling.word_counts(docs).collect()))
    monkeypatch.setattr(spelling, "_LISTED", 10)
    assert spelling.runs("Straße STRASSE strasse") == Counter({"straße": 1, "strasse": 2})
    assert want == Counter(map(tuple, spelling.word_counts(docs.repartition(4)).collect()))


def test_one_edit_flips_two_bits_at_most():
    r = random.Random(1)
    for _ in range(2000):
        w = [r.choice(spelling.LETTERS) for _ in range(r.randrange(5, 12))]
        x = list(w)
        k = r.randrange(len(x))
        x[k : k + r.randrange(2)] = r.choice(["", *spelling.LETTERS])
        a, b = spelling.masks(["".join(w), "".join(x)]).tolist()
        assert (a ^ b).bit_count() <= 2


def test_variants_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = variants(queries.table(spark, sf_dir, "documents"))
    assert got == variants_brute(rows) and any(x[1] for x in got)


def codes_brute(rows, entries=256, rounds=4, parts=4):
    """(id, code, error, label_error, digest) with Python's own integers."""
    whole = [(i, [math.floor(Fraction(x) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    some = sorted((x for x in whole if x[0] is not None), key=lambda x: (x[0], x[1]))
    length = len(some[0][1])
    whole, some = [x for x in whole if len(x[1]) == length], [x for x in some if len(x[1]) == length]
    width = -(-length // parts)
    cut = lambda v: [(v + [0] * (width * parts - length))[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in some[:entries]] for p in range(parts)]
    asked = [(i, cut(v), label) for i, v, label in whole]

    def nearest(p, x):
        away = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return min(range(len(away)), key=lambda k: (away[k], k)), min(away)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for _, v, _ in asked:
                got.setdefault(nearest(p, v[p])[0], []).append(v[p])
            new.append([[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, by_label = [], Counter()
    for i, v, label in asked:
        found = [nearest(p, v[p]) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
        by_label[label] += coded[-1][2]
    most = (1 << 63) - 1
    return Counter((i, c, min(most, e), min(most, by_label[label]), digest) for i, c, e, label in coded)


def coded(df, **sizes):
    return Counter((r[0], r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress_vectors(df, **sizes).collect())


VECTORS = "vec_id long, embedding array<double>, label int, error string, part string"


def vectors(n, length, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(r.randrange(3), 0.1) * spread for _ in range(length)], r.choice([1, 2, None]), "clash", "clash") for i in range(n)]


@pytest.mark.parametrize("length, entries, spread", [(8, 256, 1.0), (8, 16, 1.0), (6, 40, 0.003), (4, 5, 1e30)])
def test_codes(spark, length, entries, spread):
    """Awkward rows among others; ties abound in small vectors; lengths that do not divide; numbers beyond 64 bits."""
    rows = vectors(400, length, 5, spread)
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1, "", ""), (900, None, 1, "", ""), (901, [nan] * length, 1, "", ""), (902, [inf] + [0.0] * (length - 1), 2, "", ""), (903, [None] + [0.0] * (length - 1), 2, "", "")]
    rows += [(904, [1.0], 1, "", ""), (905, [], None, "", ""), rows[3], rows[3], (7, rows[9][1], 2, "", ""), (-5, [-0.0005] * length, None, "", "")]
    r = random.Random(2)
    r.shuffle(rows)
    got = coded(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
    assert got == codes_brute([x[:3] for x in rows], entries)
    assert sum(got.values()) == 405


def test_codes_of_few_rows(spark):
    df = spark.createDataFrame(vectors(3, 8, 1), VECTORS)
    assert coded(df.limit(0)) == Counter()
    assert coded(df.where("embedding IS NULL")) == Counter()
    assert coded(df) == codes_brute([tuple(r)[:3] for r in df.collect()])
    none = spark.createDataFrame([(None, [1.0] * 8, 1, "", ""), (None, [0.0] * 8, 1, "", "")], VECTORS)
    assert {r.code for r in vector_codes.compress_vectors(none).collect()} == {"00000000"}
    bare = spark.createDataFrame([(1, [], 1, "", "")], VECTORS)
    assert [(r.code, r.error) for r in vector_codes.compress_vectors(bare).collect()] == [("00000000", 0)]


def test_tree_leaves_out_balls():
    """Results of the tree are those of a scan, and most leaves are never opened where entries lie in clusters."""
    r = np.random.default_rng(4)
    centres = r.integers(-3000, 3000, (32, 16))
    entries = np.repeat(centres, 8, 0) + r.integers(-20, 20, (256, 16))
    points = centres[r.integers(0, 32, 3000)] + r.integers(-30, 30, (3000, 16))
    tree, opened = vector_codes.BallTree(entries), []
    verify = tree._verify
    tree._verify = lambda points, members, who, *out: (opened.append(len(who)), verify(points, members, who, *out))
    index, best = tree.nearest(points)
    away = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    assert (index == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    leaves = sum(n[2] is not None for n in tree.nodes)
    assert sum(opened) < 0.25 * leaves * len(points)


def test_codes_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, sf_dir, "embeddings").limit(120).collect()]
    schema = "vec_id long, embedding array<double>, label int"
    assert coded(spark.createDataFrame(rows, schema), entries=30) == codes_brute(rows, 30)
    out = queries.op13_vector_codes(spark, sf_dir)
    full = queries.table(spark, sf_dir, "embeddings")
    assert out.count() == full.count()
    pts = np.floor(np.array([r.embedding for r in full.orderBy("vec_id").collect()], np.float64) * 1024).astype(np.int64).reshape(-1, 4, 16)
    books = pts[:256].transpose(1, 0, 2).copy()
    for step in range(5):
        index = np.array([((pts[:, p, None, :] - books[p]) ** 2).sum(axis=2).argmin(axis=1) for p in range(4)])
        if step == 4:
            break
        for p in range(4):
            for k in np.unique(index[p]):
                own = pts[index[p] == k, p]
                books[p, k] = own.sum(axis=0) // len(own)
    want = ["".join(f"{k:02x}" for k in row) for row in index.T]
    assert [r.code for r in out.orderBy("vec_id").collect()] == want
    assert {r.codebooks_sha256 for r in out.collect()} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}
