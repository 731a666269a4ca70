"""Kept indexes and embeddings against the plain forms."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.operators import kept, keyword_index, search
from engram.operators.kept_embeddings import EmbeddingStore
from engram.operators.keyword_index import KeywordIndex, best_of_shard
from engram.sources import views

NOW = datetime(2024, 5, 1, 12)


def plain_best(scores, limit):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:limit]


def test_keyword_index_after_refreshes(spark, sf_dir, tmp_path):
    """Equal to the scores from the texts for 25 queries after two refreshes; no text is read."""
    notes = views.notes(spark, sf_dir).select("id", "source_text")
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.refresh(notes.where("id % 3 = 0"))
    index.refresh(notes.where("id % 3 < 2"))
    index.refresh(notes)
    sizes = [kept.read(spark, index.folder, "postings", index._postings(kept.state(spark, index.folder)).drop("v").schema, [part]).where("term = ''").count() for part in kept.state(spark, index.folder)[1]]
    assert sizes == [notes.where(f"id % 3 = {k}").count() for k in range(3)]
    items = [r.text for r in views.table(spark, sf_dir, "benchmark").orderBy("item_id").limit(22).collect()]
    asked = [(k, q) for k, q in enumerate([*items, "the toxic quality of on and", "THE the", "zzzz the ñ of"])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    scores = index.scores(queries)
    assert "documents.parquet" not in "".join(scores.inputFiles())
    got: dict = {k: {} for k, _ in asked}
    for r in scores.collect():
        got[r.query_id][r.id] = r.score
    for k, q in asked[::6] + asked[-3:]:
        plain = {r.id: r.score for r in search.bm25(notes, q).select("id", F.round("score", 4).alias("score")).collect()}
        assert got[k].keys() == plain.keys() and all(abs(got[k][i] - plain[i]) < 1.5e-4 for i in plain)
    best = index.best(queries, 5)
    found: dict = {k: [] for k, _ in asked}
    for r in best.orderBy("query_id", F.desc("score"), "id").collect():
        found[r.query_id].append((r.id, r.score))
    assert found == {k: plain_best(got[k], 5) for k, _ in asked}


def test_lists_are_left_early():
    """Against the whole sums; most of the common lists are not gone through."""
    pick = np.random.default_rng(5)
    terms, ids, impacts = [], [], []
    for k in range(40):
        rows = pick.choice(3000, 20 * (k + 1), replace=False)
        terms += [f"t{k}"] * len(rows)
        ids += rows.tolist()
        impacts += (pick.uniform(0.5, 1, len(rows)) * 60 / (k + 1) ** 1.5).round(2).tolist()
    wants = [[f"t{k}" for k in pick.choice(50, 12, replace=False)] for _ in range(30)]
    q, found, scores, gone_through = best_of_shard(pa.array(terms), pa.array(ids), np.array(impacts), wants, 4)
    got = list(zip(q.tolist(), found.to_pylist(), scores.tolist()))
    want, entries = [], 0
    for n, names in enumerate(wants):
        total: dict = {}
        for t, i, x in zip(terms, ids, impacts):
            if t in names:
                total[i] = total.get(i, 0.0) + x
                entries += 1
        want += [(n, i, round(x, 4)) for i, x in plain_best({i: round(x, 4) for i, x in total.items()}, 4)]
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    assert gone_through < entries / 2


def test_keyword_index_of_random_changes(spark, tmp_path, monkeypatch):
    """Additions, changed texts and deletions, then a merge: always what the texts give."""
    pick = random.Random(7)
    words = [chr(97 + k) * 2 for k in range(12)]
    texts = {k: " ".join(pick.choices(words, weights=range(1, 13), k=pick.randint(0, 30))) for k in range(80)}
    texts[5], texts[6] = None, ""
    frame = lambda t: spark.createDataFrame(list(t.items()), "id long, source_text string")
    queries = spark.createDataFrame([(0, "aa bb ll"), (1, "ll kk"), (2, "none"), (3, "aa"), (4, None), (5, "")], "query_id long, query string")

    def check(index):
        notes = frame(texts)
        assert sorted(r.id for r in index.ids().collect()) == sorted(texts)
        got = sorted((r.query_id, r.id, r.score) for r in index.scores(queries).collect())
        want = []
        for k, q in ((0, "aa bb ll"), (1, "ll kk"), (2, "none"), (3, "aa")):
            want += [(k, r.id, r.score) for r in search.bm25(notes, q).select("id", F.round("score", 4).alias("score")).collect()]
        assert got == sorted(want)
        best = sorted((r.query_id, r.id, r.score) for r in index.best(queries, 4).collect())
        each = {k: plain_best({i: s for j, i, s in got if j == k}, 4) for k in range(4)}
        assert best == sorted((k, i, s) for k, pairs in each.items() for i, s in pairs)

    monkeypatch.setattr(keyword_index, "SHARD", 16)
    monkeypatch.setattr(keyword_index, "BLOCK", 2)
    index = KeywordIndex(spark, str(tmp_path / "i"))
    assert index.best(queries).count() == 0 and index.ids().count() == 0
    index.refresh(frame({k: t for k, t in texts.items() if k < 40}).union(spark.createDataFrame([(None, "aa")], "id long, source_text string")))
    index.refresh(frame(texts))
    check(index)
    for k in (1, 41, 5):
        texts[k] = "aa aa zz ll"
    gone = spark.createDataFrame([(k,) for k in (1, 41, 5, 7, 8, 999)], "id long")
    del texts[7], texts[8]
    index.refresh(frame(texts), gone)
    check(index)
    index.refresh(frame(texts))
    check(index)
    index.merge()
    assert len(kept.state(spark, index.folder)[1]) == 1
    check(index)
    assert len(kept.tidy(spark, index.folder, keep=1, seconds=0, now=datetime(2100, 1, 1))) == 4
    check(index)
    with pytest.raises(ValueError, match="twice"):
        index.refresh(spark.createDataFrame([(500, "aa"), (500, "bb")], "id long, source_text string"))
    check(index)


def test_late_writers_add_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    begun = kept.state(spark, folder)
    kept.add(spark, folder, begun, lambda write: write("rows", spark.range(3)))
    with pytest.raises(ValueError, match="meanwhile"):
        kept.add(spark, folder, begun, lambda write: write("rows", spark.range(5)))
    assert kept.read(spark, folder, "rows", spark.range(1).schema).count() == 3


def test_kept_embeddings(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    folder = str(log)

    def model(batch):
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("".join(t + "\n" for t in batch))
        return [None if t == "bad" else [float(len(t)), 1.0] for t in batch]

    def asked():
        return sorted(line for f in log.iterdir() for line in f.read_text().split("\n") if line)

    store = EmbeddingStore(spark, str(tmp_path / "s"), model, 2)
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    figures = lambda: tuple(store.figures().first())
    assert figures() == (0, 0, 0, None)
    one = {r.text: r.embedding for r in store.embed(frame("a", "bb", "a", "", None, " ", "bad"), NOW).collect()}
    assert one == {"a": [1.0, 1.0], "bb": [2.0, 1.0], "": None, None: None, " ": None, "bad": None}
    assert asked() == ["a", "bad", "bb"] and figures() == (4, 1, 3, 0.25)
    again = store.embed(frame("a", "bb", "a"), NOW + timedelta(hours=20)).collect()
    assert len(again) == 2 and asked() == ["a", "bad", "bb"] and figures() == (7, 4, 3, 4 / 7)
    store.embed(frame("a", "ccc"), NOW + timedelta(hours=40))  # a use puts the end off
    assert asked() == ["a", "bad", "bb", "ccc"]
    got = store.embed(frame("a", "bb"), NOW + timedelta(hours=50)).collect()  # bb was last used 30 hours ago
    assert len(got) == 2 and asked() == ["a", "bad", "bb", "bb", "ccc"] and figures() == (11, 6, 5, 6 / 11)
    store.merge(NOW + timedelta(hours=51), most=2)
    assert figures() == (11, 6, 5, 6 / 11)
    store.embed(frame("a", "bb"), NOW + timedelta(hours=52))
    assert asked() == ["a", "bad", "bb", "bb", "ccc"]
    store.embed(frame("ccc"), NOW + timedelta(hours=52))  # went as the one used longest ago
    assert asked() == ["a", "bad", "bb", "bb", "ccc", "ccc"]


def test_second_ingest_asks_no_model(spark, tmp_path):
    from engram.operators import mutate

    calls = tmp_path / "calls"
    path = str(calls)

    def model(batch):
        with open(path, "a") as f:
            f.write("x" * len(batch))
        return [[1.0] * 384 for _ in batch]

    store = EmbeddingStore(spark, str(tmp_path / "s"), model)
    kinds = "user_id string, text string, type string, entities array<struct<type:string,value:string,entity_type:string,normalized:string>>, metadata string, screenshot string, extracted_text string"
    rows = spark.createDataFrame([("u", f"text {k % 5}", None, [], None, None, None) for k in range(9)], kinds)
    first = mutate.ingest(rows, store.embedder(NOW), NOW)[0].count()
    made = calls.read_text()
    assert first == 9 and made == "x" * 5
    assert mutate.ingest(rows, store.embedder(NOW), NOW)[0].count() == 9 and calls.read_text() == made
