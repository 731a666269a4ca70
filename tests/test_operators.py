"""Operators against hand-written cases and plain Python."""

import json
import math
import random
import re
import time
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import embedding, ranking, text, vector
from engram.operators import enrich, episodic, filters, folds, mutate, rules, search, upkeep, vector_index
from engram.schema import SCHEMAS, memory_id, migrate, text_error, valid_entities, valid_metadata
from engram.sources import views
from engram.streaming import captures as stream

NOW = datetime(2024, 5, 1, 12)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- records -------------------------------------------------------------------------------------


def test_text_rules(spark):
    rows = spark.createDataFrame([("  ok ",), ("",), (None,), ("   ",), ("x" * 10_001,), ("x" * 10_000,)], "t string")
    assert [r[0] is None for r in rows.select(text_error(F.col("t"))).collect()] == [True, False, False, False, False, True]


def test_metadata_and_ids(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [2]}',), ("broken{",), (None,), ("[1]",)], "m string")
    assert [r[0] for r in rows.select(valid_metadata(F.col("m"))).collect()] == ['{"a":[2],"b":1}', "{}", "{}", "{}"]
    assert spark.range(1).select(memory_id(F.lit(1700000000000), F.lit("x"))).first()[0].startswith("mem_1700000000000_")


def test_entities_valid_and_capped(spark):
    many = [("T", f"v{i}", None, None) for i in range(150)]
    frame = spark.createDataFrame([([("T", "v", None, None), ("", "v", None, None), ("T", None, None, None)],), (many,), (None,)], "e array<struct<type:string,value:string,entity_type:string,normalized:string>>")
    assert [r[0] for r in frame.select(F.size(valid_entities(F.col("e")))).collect()] == [1, 100, 0]


def test_migrate_adds_columns(spark):
    old = spark.createDataFrame([("r1", "site", "a.com", "do")], "id string, context_type string, context_key string, rule_text string")
    new = migrate(old, "context_rules")
    assert new.columns == spark.createDataFrame([], SCHEMAS["context_rules"]).columns and new.first().priority is None


# --- filters and plans ---------------------------------------------------------------------------


def test_time_range_precedence(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i)) for i in range(20)], "id long, at timestamp_ntz")
    ids = lambda **k: [r.id for r in rows.where(filters.time_range(F.col("at"), datetime(2024, 1, 20), **k)).collect()]
    assert ids(max_age_days=3) == [16, 17, 18, 19]
    assert ids(start=datetime(2024, 1, 2), max_age_days=1) == list(range(1, 20))
    assert ids(max_age_days=0) == ids(max_age_days=None) == list(range(20))
    assert ids(end=datetime(2024, 1, 3), max_age_days=0) == [0, 1, 2]


def test_types_and_captures(spark):
    rows = spark.createDataFrame([("a",), ("screen_capture",), (None,)], "type string")
    kinds = lambda *a: [r.type for r in rows.where(filters.types_in(F.col("type"), *a)).collect()]
    assert kinds() == ["a"] and kinds("screen_capture") == ["screen_capture"] and kinds(None, "a") == []


def test_sort_is_limited_to_known_columns(spark):
    with pytest.raises(ValueError):
        filters.sorted_page(spark.range(1), "id; drop")


def test_plans(spark, sf_dir):
    """Top-k without a full sort, pruned scans, pushed filters, no Cartesian product."""
    top = plan(search.nearest(views.vectors(spark, sf_dir), views.vector_of(spark, sf_dir)))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    listed = plan(views.table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in listed and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in listed
    best = plan(filters.best_per(views.captures(spark, sf_dir), "user_id", F.desc("value")))
    assert "WindowGroupLimit" in best and "Partial" in best
    hybrid = plan(search.hybrid(views.memory(spark, sf_dir), views.entities(spark, sf_dir), "the toxic", views.vector_of(spark, sf_dir), NOW))
    assert "CartesianProduct" not in hybrid


# --- ranking -------------------------------------------------------------------------------------


def test_cosine_forms_agree(spark):
    r = np.random.default_rng(0)
    rows, q = r.normal(size=(30, 7)), r.normal(size=7)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, embedding array<double>")
    got = frame.select(vector.cosine_to(F.col("embedding"), q.tolist()).alias("a"), vector.cosine(F.col("embedding"), F.array(*map(F.lit, q.tolist()))).alias("b")).collect()
    want = rows @ q / np.linalg.norm(rows, axis=1) / np.linalg.norm(q)
    assert np.allclose([x.a for x in got], want) and np.allclose([x.b for x in got], want)


@pytest.mark.parametrize("block", [3, 2048])
def test_lookup_many(spark, block):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 5))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = frame.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = set()
    for q in range(0, 60, 4):
        order = sorted((i for i in range(60) if i != q and sims[q, i] >= 0.2), key=lambda i: (-sims[q, i], i))[:2]
        want |= {(q, i) for i in order}
    assert {(m.query_id, m.id) for m in search.lookup_many(frame, asked, 0.2, 2, block, others_only=True).collect()} == want


def test_index_recall_and_share(spark, sf_dir):
    """The query set (ids divisible by 20) against all rows: most of the true neighbours from at most a fifth of the rows."""
    rows = views.vectors(spark, sf_dir).select("id", "embedding").cache()
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = vector_index.build(rows)
    assert index.lists(spark).count() == rows.count()
    want = {(r.query_id, r.id) for r in search.lookup_many(rows, asked, -1.0, limit=10).collect()}
    got = {(r.query_id, r.id) for r in vector_index.search(index, asked, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert vector_index.compared_share(index, asked) <= 0.2
    every = {(r.query_id, r.id) for r in vector_index.search(index, asked, 10, len(index.centres), every=True).collect()}
    assert every == want
    q = asked.first()
    one = vector_index.nearest(index, spark, list(q.query_embedding), 10)
    assert len({r.id for r in one.collect()} & {i for k, i in want if k == q.query_id}) >= 7
    assert "cell#" in one._jdf.queryExecution().toString().split("PartitionFilters:")[1][:200]
    again = vector_index.open_index(spark, index.path)
    assert {(r.query_id, r.id) for r in vector_index.search(again, asked, 10).collect()} == got
    vector_index.add(again, rows.where("id < 30").withColumn("id", F.col("id") + 1_000_000))
    assert again.lists(spark).count() == rows.count() + 30


def test_index_of_clusters(spark):
    """Where vectors lie in clusters, few lists are looked into."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 6
    x = centres[r.integers(0, 40, 2000)] + r.normal(size=(2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = vector_index.build(rows)
    want = {(q.query_id, q.id) for q in search.lookup_many(rows, asked, -1.0, limit=10).collect()}
    got = {(q.query_id, q.id) for q in vector_index.search(index, asked, 10, every=True).collect()}
    assert len(got & want) >= 0.9 * len(want) and index.probes <= len(index.centres) // 5
    assert vector_index.compared_share(index, asked) <= 0.2


def test_index_of_awkward_rows(spark):
    kind = "id long, embedding array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [-1.0, 0.5])], kind)
    asked = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    for got in (vector_index.match(rows, asked, 0.9, 2), search.lookup_many(rows, asked, 0.9, 2), search.lookup_many(rows, asked, 0.9, 2, 1)):
        assert {(r.query_id, r.id) for r in got.collect()} == {(1, 1), (1, 5), (5, 1), (5, 5), (6, 6)}
    assert vector_index.match(rows.limit(0), asked, 0.5).count() == 0 and vector_index.match(rows, asked.limit(0), 0.5).count() == 0
    assert vector_index.search(vector_index.build(rows.where("id = 2")), asked, 3).count() == 0
    assert vector_index.search(vector_index.build(rows), asked, 1, 9).count() == 3


def test_match_of_large_sets(spark):
    """Cells of several parts with a hot one, against a matrix; the same number of jobs for few and many queries, no nested loops."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 4
    x = centres[np.minimum(r.integers(0, 30, 1500), 11)] + r.normal(size=(1500, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4).cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    jobs = []
    for n in (100, 1500):
        asked = frame.where(f"id < {n}").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
        spark.sparkContext.setJobGroup(f"match {n}", "match")
        out = vector_index.match(frame, asked, 0.97, 2, part=64, others_only=True)
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
        got = {(m.query_id, m.id) for m in out.collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"match {n}")))
        sims = np.round(unit[:n] @ unit.T, 6)
        sims[np.arange(n), np.arange(n)] = -2
        want = {(q, int(i)) for q in range(n) for i in np.lexsort((np.arange(1500), -sims[q]))[:2] if sims[q, i] >= 0.97}
        assert got == want and len(want) > n // 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 4


def test_recency_rules_differ_near_midnight(spark):
    row = spark.createDataFrame([(datetime(2024, 4, 30, 23), datetime(2024, 5, 1, 1))], "c timestamp_ntz, n timestamp_ntz")
    got = row.select(ranking.recency_calendar(F.col("c"), F.col("n")), ranking.recency_elapsed(F.col("c"), F.col("n"))).first()
    assert got[0] == pytest.approx(1 / (1 + math.log(2))) and got[1] == 1.0


def test_hybrid_cut_comes_after_the_limit(spark):
    """Rows found by keywords alone take places and are then cut; a flag keeps them."""
    rows = [(i, "note", "plain words here", [1.0, i / 10.0], datetime(2024, 4, 1)) for i in range(4)] + [(9, "note", "rare keyword", [-1.0, 0.0], datetime(2024, 5, 1))]
    memories = spark.createDataFrame(rows, "id long, type string, source_text string, embedding array<double>, created_at timestamp_ntz")
    entities = spark.createDataFrame([(9, "rare thing")], "memory_id long, entity string")
    run = lambda **k: [r.id for r in search.hybrid(memories, entities, "rare words", [1.0, 0.0], NOW, limit=2, **k).collect()]
    assert 9 in run(keep_keyword_only=True) or len(run()) <= 2
    everything = search.hybrid(memories, entities, "rare words", [1.0, 0.0], NOW, limit=10, min_similarity=None).collect()
    assert all(-0.5 <= r.score <= 1.0 for r in everything) and {r.id for r in everything} == {0, 1, 2, 3, 9}


def test_min_max_of_equal_scores_is_zero(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, score double")
    assert [r.scaled for r in search.min_max(rows).collect()] == [0.0, 0.0]


# --- captures ------------------------------------------------------------------------------------


def test_dedup_mixes_columns_unless_whole_rows(spark):
    rows = spark.createDataFrame([(1, "c", "b", '{"k":"x"}', datetime(2024, 1, 1, 5, 30)), (2, "c", "a", '{"k":"x"}', datetime(2024, 1, 1, 5, 10)), (3, "c", "z", None, datetime(2024, 1, 1, 5, 10))], "id long, type string, source_text string, metadata string, created_at timestamp_ntz")
    mixed = {r.id: r for r in episodic.dedup_hourly(rows, ["k"]).collect()}
    assert mixed[1].source_text == "a" and mixed[1].created_at == datetime(2024, 1, 1, 5, 10) and set(mixed) == {1, 3}
    whole = {r.id: r for r in episodic.dedup_hourly(rows, ["k"], whole_rows=True).collect()}
    assert whole[1].source_text == "b"


def shots(spark, texts, **more):
    rows = [(datetime(2024, 1, 1, 0, 0, i), i, 1, "Mail", "t", 0, 1.0, 100, 100, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, capture_id long, user_id long, app string, title string, idle_ms long, diff_ratio double, width int, height int, ocr_raw string")


def test_only_consecutive_repeats_go(spark):
    frame = shots(spark, ["AAAAAAAAAAAA", "BBBBBBBBBBBB", "BBBBBBBBBBBB", "AAAAAAAAAAAA"])
    assert [r.capture_id for r in stream.drop_repeats(frame).orderBy("capture_id").collect()] == [0, 1, 3]
    assert [r.capture_id for r in stream.gated(frame).orderBy("capture_id").collect()] == [0, 1, 3]


def test_new_lines_keep_repeats(spark):
    row = spark.createDataFrame([("one line here\n two line here \ntwo line here\nshort", "one line here")], "c string, b string")
    assert row.select(stream.new_lines(F.col("c"), F.col("b"))).first()[0] == ["two line here", "two line here"]


def test_watch_stream(spark, tmp_path):
    frame = shots(spark, ["first long line", "first long line\nsecond long line", "second long line", "second long line\nfirst long line"])
    frame.repartitionByRange(2, "ts").write.parquet(f"{tmp_path}/in")
    sessions = spark.createDataFrame([("s1", 1, "Mail", "first long line")], "session_id string, user_id long, app string, baseline string")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    stream.store_batches(stream.watch_stream(source, sessions), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    got = {(r.capture_id, tuple(r.new_lines)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.capture_id, tuple(r.new_lines)) for r in stream.watch(frame, sessions).collect()}
    assert got == want == {(1, ("second long line",)), (3, ("first long line",))}


def test_users_are_forgotten(spark, tmp_path):
    """A stream in three runs gives what the table form gives; states go after the time; a plain loop agrees; null users and ties."""
    from datetime import timedelta

    forget, r, at, rows = 600, random.Random(3), datetime(2024, 1, 1), []
    for i in range(300):
        at += timedelta(seconds=r.choice([0, 20, 100, 599, 600, 601]))
        rows.append((at, i, r.choice([1, 2, None]), r.choice(["Code", "Code", "Electron"]), r.choice("xxxy"), r.choice([0, 0, 400_000]), r.choice([0.1, 0.1, 0.5, None]), 100, 100, r.choice(["text number one", "text number two", "short", None])))
    rows.append((at + timedelta(days=1), 300, 9, "Code", "x", 0, 0.1, 100, 100, "text number one"))
    names = "ts timestamp_ntz, capture_id long, user_id long, app string, title string, idle_ms long, diff_ratio double, width int, height int, ocr_raw string"
    state, want = {}, set()
    for t, i, user, app, title, idle, diff, _, _, ocr in rows:
        if idle > 300_000 or app == "Electron":
            continue
        old = state.get(user)
        if old and (t - old[0]).total_seconds() > forget:
            old = None
        changed = old is None or old[1] != (app, title)
        told = (changed or diff is None or diff > 0.15) and len(ocr or "") >= 10
        if told and (changed or old[2] != ocr):
            want.add((i, changed))
        state[user] = (t, (app, title), ocr if told else old and old[2])
    df = spark.createDataFrame(rows, names)
    assert {(x.capture_id, x.changed) for x in stream.gated(df.repartition(5), forget=forget).collect()} == want
    assert {(x.capture_id, x.changed) for x in stream.gated(df).collect()} != want
    for part in range(3):
        df.where(F.col("capture_id").between(part * 101, part * 101 + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        run = stream.store_batches(stream.gated_stream(source, forget=forget, late="0 seconds"), f"{tmp_path}/out/run={part}", f"{tmp_path}/state", once=True)
        run.awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert {(x.capture_id, x.changed) for x in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/state")
    assert [x.key[0] for x in kept.collect()] == ['{"user_id":9}']


def test_watch_sessions_end(spark, tmp_path):
    frame = shots(spark, ["first long line", "second long line", "third long line", "fourth long line"])
    times = [x.ts for x in frame.orderBy("capture_id").collect()]
    seconds = int((times[2] - times[1]).total_seconds())
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    sessions = spark.createDataFrame([("s1", 1, "Mail", "first long line", times[1]), ("s2", 1, "Mail", "", None)], f"session_id string, user_id long, app string, baseline string, started_at {frame.schema['ts'].dataType.simpleString()}")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    stream.store_batches(stream.watch_stream(source, sessions, seconds), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    got = {(x.session_id, x.capture_id) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(x.session_id, x.capture_id) for x in stream.watch(frame, sessions, seconds).collect()} == {("s1", 1), ("s1", 2), ("s2", 0), ("s2", 1), ("s2", 2), ("s2", 3)}
    kept = spark.read.format("statestore").option("stateVarName", "base").load(f"{tmp_path}/state")
    assert [x.key.session_id for x in kept.collect()] == ["s2"]


def test_settings_of_two_threads(spark):
    from engram.storage import with_settings

    name = "spark.sql.engram.test"
    with with_settings(spark, {name: "1"}):
        inner = with_settings(spark, {name: "1"})
        inner.__enter__()
    assert spark.conf.get(name) == "1"
    inner.__exit__(None, None, None)
    assert spark.conf.get(name, None) is None


# --- changes -------------------------------------------------------------------------------------


def test_upserts_are_idempotent(spark):
    base = spark.createDataFrame([("r1", "site", "a.com", "do x")], "id string, context_type string, context_key string, rule_text string")
    change = spark.createDataFrame([("n1", "web", " A.com ", "do x "), ("n2", "App", "mail", "be brief"), ("n3", "app", "MAIL", "be brief")], base.schema)
    once = mutate.upsert_context_rules(base, change)
    assert sorted(map(tuple, once.collect())) == [("n2", "app", "mail", "be brief"), ("r1", "site", "a.com", "do x")]
    assert sorted(map(tuple, mutate.upsert_context_rules(once, change).collect())) == sorted(map(tuple, once.collect()))


def test_phrases(spark):
    schema = "id string, example_phrase string, delivery string, service string, embedding array<double>, source string"
    base = spark.createDataFrame([("p1", "send it", "sms", None, [1.0, 0.0], "user_answer"), ("p2", "other", "push", None, [0.0, 1.0], "user_answer")], schema)
    put = lambda *row: sorted(r.id for r in mutate.upsert_phrases(base, spark.createDataFrame([row], schema)).collect())
    assert put("n", "send it", "sms", None, [1.0, 0.01], "user_answer") == ["p1", "p2"]
    assert put("n", "send it", "email", None, [1.0, 0.01], "user_answer") == ["n", "p2"]
    assert put("n", "send it", "sms", None, [1.0, 0.01], "user_correction") == ["n", "p2"]
    assert put("n", "new", "sms", None, [1.0, -9.0], "user_answer") == ["n", "p1", "p2"]


def test_severity_sort_of_all_rows(spark, tmp_path):
    from engram.plans.retrieval import severity_sort

    spark.range(100).select(F.col("id").alias("s_suppkey"), F.col("id").cast("string").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = [r.s_suppkey for r in severity_sort(spark, str(tmp_path)).collect()]
    assert got == [i for i in range(100) if i % 3 == 0] + [i for i in range(100) if i % 3]


def test_rules_of_all_keys(spark):
    kind = "id long, context_key string, rule_text string, priority int, verified_count int, hit_count int, status string"
    rules_ = spark.createDataFrame([(i, f"k{i % 12}", f"r{i}", i, 0, 0, "retired" if i % 5 == 0 else None) for i in range(60)], kind)
    got = {r.context_key: r.rules for r in enrich.rules_by_key(rules_).collect()}
    assert got == {f"k{k}": [f"r{i}" for i in range(59, -1, -1) if i % 12 == k and i % 5] for k in range(12)}


def test_semantic_upserts_take_every_row(spark, sf_dir):
    """Stored rows and changes together are the whole table, and each change goes somewhere."""
    from engram.plans import upkeep as plans

    rows = {r.id: r for r in views.vectors(spark, sf_dir).select("id").collect()}
    found = [r.prompt_text for r in plans.semantic_dedup_upsert(spark, sf_dir).collect()]
    assert len(found) >= len(rows) // 2 and {f"prompt {i}" for i in rows} >= set(found)
    changes = views.vectors(spark, sf_dir).where("id % 2 = 1").select("id", "embedding")
    match = mutate.closest(views.vectors(spark, sf_dir).where("id % 2 = 0"), changes, -1.0)
    assert match.count() == sum(i % 2 for i in rows)
    assert "CartesianProduct" not in plan(match) and "BroadcastNestedLoop" not in plan(match)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_closest_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(search.lookup_many, "__defaults__", (1, 2, False))  # blocks of two changes
    frame = lambda ids, r: spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in ids], "id long, embedding array<float>").withColumn("id", F.col("id").cast(kind))
    base, changes = frame(range(100, 140), np.random.default_rng(1)), frame(range(200, 211), np.random.default_rng(2))
    got = {int(m.change_id): int(m.id) for m in mutate.closest(base, changes, -1.0).collect()}
    unit = lambda df: {int(r.id): np.array(r.embedding) / np.linalg.norm(r.embedding) for r in df.collect()}
    rows = unit(base)
    assert got == {c: max(rows, key=lambda i: rows[i] @ v) for c, v in unit(changes).items()}


def test_ingest_gives_each_row_an_id(spark):
    """Copies within a source, rows that differ in other fields alone, and refused ones, against counts by hand."""
    kind = "user_id string, text string, type string, entities array<struct<type:string,value:string,entity_type:string,normalized:string>>, metadata string, screenshot string, extracted_text string"
    e = [("T", "v", None, None), ("T", "w", None, None)]
    rows = [("a", "same text", None, e, "{}", None, None)] * 5 + [("a", " same text", None, e[:1], "{}", None, None), ("b", "same text", None, [], "{}", None, None), ("a", "", None, e, "{}", None, None)]
    embed = lambda texts: texts.withColumn("embedding", F.array(F.lit(1.0)))
    memories, ents, refused = mutate.ingest(spark.createDataFrame(rows, kind), embed, NOW)
    ids = [r.id for r in memories.collect()]
    assert len(ids) == len(set(ids)) == 7 and refused.count() == 1
    of = {r.memory_id: r["count"] for r in ents.groupBy("memory_id").count().collect()}
    assert set(of) <= set(ids) and sorted(of.values()) == [1] + [2] * 5
    assert sorted(r.id for r in mutate.ingest(spark.createDataFrame(rows[::-1], kind), embed, NOW)[0].collect()) == sorted(ids)


def test_ingest_query(spark, sf_dir):
    """As many rows as documents, each stored one with an id and one entity of its own."""
    from engram.plans.upkeep import ingest_memories

    docs = [r.text for r in views.table(spark, sf_dir, "documents").collect()]
    good = [t for t in docs if t and len(t) <= 10_000 and t.strip(" ")]
    got = ingest_memories(spark, sf_dir).collect()
    stored = [r for r in got if r.error is None]
    assert len(got) == len(docs) and len(stored) == len({r.id for r in stored}) == len(good) and {r.n_entities for r in stored} == {1}


def test_update_keeps_type_and_creation(spark):
    base = spark.createDataFrame([("m1", "u", "note", "old", "{}", None, None, [0.0], NOW, NOW), ("m2", "u", "note", "rest", "{}", None, None, [0.0], NOW, NOW)], SCHEMAS["memory"])
    ents = spark.createDataFrame([("m1", "a"), ("m2", "b")], "memory_id string, entity string")
    change = spark.createDataFrame([("m1", "new text", None)], "id string, source_text string, metadata string")
    later = datetime(2024, 6, 1)
    out, left = mutate.update_memories(base, ents, change, spark.createDataFrame([("m1", "c")], ents.schema), embedding.embedder(), later)
    row = {r.id: r for r in out.collect()}
    assert row["m1"].source_text == "new text" and len(row["m1"].embedding) == 384 and row["m1"].created_at == NOW and row["m1"].updated_at == later and row["m2"].updated_at == NOW
    assert sorted(map(tuple, left.select("memory_id", "entity").collect())) == [("m1", "c"), ("m2", "b")]


@pytest.mark.parametrize("offset", [0, 1_000_000, 1_199_990, 1_300_000])
def test_deep_pages(spark, offset):
    """A page far down a list of repeated and null values is that of the sorted list."""
    rows = spark.range(0, 1_200_000, 1, 7).select("id", F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(5000))).alias("v"))
    order = (F.desc_nulls_last("v"), F.asc("id"))
    plain = rows.toPandas().sort_values(["v", "id"], ascending=[False, True], na_position="last").id.tolist()
    assert [r.id for r in filters.deep_page(rows, *order, limit=25, offset=offset).collect()] == plain[offset : offset + 25]
    if offset == 1_000_000:
        assert [r.id for r in filters.top(rows, *order, limit=25, offset=offset).collect()] == plain[offset : offset + 25]


def test_places_in_order(spark):
    """Over many ranges, with a null, ties within the first key and one key that holds most rows."""
    r = random.Random(5)
    rows = [(r.choice([7, 7, 7, 7, 1, 2, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = filters.placed(df, F.desc_nulls_last("k"), F.asc("i"), name="at")
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(x.k, x.i) for x in sorted(got.collect(), key=lambda x: x.at)] == want and got.columns == ["k", "i", "at"]
    assert sorted(x.at for x in got.collect()) == list(range(1, 501))
    assert filters.placed(df.limit(0), F.asc("i")).count() == 0


def test_versions(spark, tmp_path):
    folder = f"{tmp_path}/t"
    mutate.replace_table(spark.range(3), folder, "001")
    mutate.replace_table(spark.range(5), folder, "002")
    assert mutate.read_latest(spark, folder).count() == 5


def test_versions_are_committed(spark, tmp_path):
    """In the order of commits, not of names; failed writes and late writers commit nothing; readers keep their version."""
    folder = str(tmp_path / "t")
    with pytest.raises(ValueError):
        mutate.read_latest(spark, folder)
    mutate.replace_table(spark.range(10), folder, "2024-9")
    old = mutate.read_latest(spark, folder)
    mutate.replace_table(spark.range(20), folder, "2024-10")
    assert mutate.read_latest(spark, folder).count() == 20 and old.count() == 10
    with pytest.raises(Exception, match="stop"):
        mutate.replace_table(spark.range(30).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), folder, "broken")
    assert mutate.read_latest(spark, folder).count() == 20
    begun = mutate.table_commits(spark, folder)[-1][0]  # two writers from the same version
    mutate.replace_table(spark.range(40), folder, "first", after=begun)
    with pytest.raises(ValueError, match="meanwhile"):
        mutate.replace_table(spark.range(50), folder, "second", after=begun)
    assert mutate.read_latest(spark, folder).count() == 40
    assert [v for _, v in mutate.table_commits(spark, folder)] == ["2024-9", "2024-10", "first"]
    assert mutate.tidy_table(spark, folder) == []
    assert mutate.tidy_table(spark, folder, seconds=0, now=datetime(2100, 1, 1)) == ["2024-9", "broken", "second"]
    assert mutate.read_latest(spark, folder).count() == 40
    with pytest.raises(ValueError):
        mutate.replace_table(spark.range(1), folder, "a/b")


def test_seed_twice(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, key string")
    once = mutate.seed(rows.limit(0), rows, ["key"])
    assert mutate.seed(once, rows.withColumn("id", F.lit("9")), ["key"]).count() == 2


def test_retention_waits_for_a_long_span(spark):
    rows = lambda *years: spark.createDataFrame([(y, datetime(y, 6, 1)) for y in years], "id long, created_at timestamp_ntz")
    ents = spark.createDataFrame([(2010, "a"), (2023, "b")], "memory_id long, entity string")
    assert upkeep.cutoff(rows(2020, 2024)) is None
    kept, left = upkeep.retain(rows(2010, 2011, 2023), ents)
    assert sorted(r.id for r in kept.collect()) == [2011, 2023] and [r.memory_id for r in left.collect()] == [2023]


# --- rules, text, folds --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "query, alone, within",
    [
        ("what did I say first?", ("GENERAL", 0.95), ("POSITIONAL", 0.95)),
        ("what topics did we discuss?", ("GENERAL", 0.95), ("GENERAL", 0.60)),
        ("summarize our conversation", ("GENERAL", 0.95), ("OVERVIEW", 0.90)),
        ("what is the weather today?", ("GENERAL", 0.95), ("GENERAL", 0.50)),
        ("as you mentioned, do it", ("POSITIONAL", 0.70), ("POSITIONAL", 0.98)),
    ],
)
def test_query_classes(spark, query, alone, within):
    rows = spark.createDataFrame([(query, False), (query, True)], "q string, c boolean")
    got = rules.classify_query(F.col("q"), F.col("c"))
    assert [tuple(r) for r in rows.select(got["classification"], got["confidence"]).collect()] == [alone, within]


def test_accented_letters_end_ascii_words(spark):
    """As in the patterns' own form: an accented letter is no part of a word."""
    row = spark.createDataFrame([("\u00e9ou\u00e8our\u00e9 what did i\u2028say", "a.js\u00e9 b.jsx", "const\u00e9\nconstant")], "q string, names string, code string")
    got = rules.classify_query(F.col("q"), F.lit(True))
    assert tuple(row.select(got["classification"], got["confidence"]).first()) == ("POSITIONAL", 0.95)
    told = rules.classify_query(F.lit("\u00e9ou\u00e8our\u00e9"), F.lit(True))
    assert tuple(row.select(told["classification"], told["confidence"]).first()) == ("GENERAL", 0.60)
    assert row.select(text.file_names(F.col("names"))).first()[0] == ["a.js", "b.jsx"]
    assert row.select(text.code_snippets(F.col("code"))).first()[0] == ["const\u00e9"]


def test_constraint_without_blocks_blocks_everything(spark):
    c = spark.createDataFrame([("1", "global", "anything", None, "hard", None)], "id string, scope string, rule string, blocks string, severity string, override_pin string")
    r = spark.createDataFrame([(1, "x", ["a"], None, None)], "request_id long, scope string, actions array<string>, message string, pin string")
    assert rules.check_constraints(c, r).first().blocked


def rule_words(t):
    return {w for w in re.split("[^A-Za-z0-9_]+", (t or "").lower()) if len(w) > 2 and w not in rules.STOP_WORDS}


def applies(rule, request):
    """The rule of one constraint and one request, in plain Python."""
    (_, scope, text, blocks, _, _), (_, wanted, actions, message, _) = rule, request
    globs = json.loads(blocks) if blocks else []
    if wanted and scope not in ("global", wanted):
        return False
    fits = any(re.fullmatch(g.replace(".", r"\.").replace("*", ".*"), a, re.I | re.A) for g in globs for a in actions or [])
    return not globs or fits or bool(rule_words(text) & rule_words(message))


RULE, REQUEST = "id long, scope string, rule string, blocks string, severity string, override_pin string", "request_id long, scope string, actions array<string>, message string, pin string"


def test_constraints_of_every_kind(spark):
    pick = random.Random(3)
    globs = ["*", "a.*", "*.x", "*mid*", "A.B", "a.b*c", "(a|b).x", "a+", "very.long.name.of.a.skill.*", "*of.a.skill.with.an.end", ".*", "a.x\n", ""]
    actions = ["a.b", "A.x", "b.x", "aaa", "a.bzzc", "very.long.name.of.a.skill.run", "a skill mid way", "the.of.a.skill.with.an.end", "a.x\n", "", ".hid"]
    words = ["delete", "files", "never", "the", "Mail", "go", "cat_9", ""]
    scopes = ["global", "s1", "s2", None, ""]
    blocks = lambda: pick.choice([None, "[]", json.dumps(pick.choices(globs, k=pick.randint(1, 3)))])
    some = lambda of, n: pick.choice([None, pick.choices(of, k=pick.randint(0, n))])
    held = [(k, pick.choice(scopes), " ".join(some(words, 4) or []), blocks(), pick.choice(["hard", "soft"]), None) for k in range(90)]
    asked = [(k, pick.choice(scopes), some(actions, 3), " ".join(some(words, 4) or []), None) for k in range(60)]
    got = sorted((r.request_id, r.id) for r in rules.matching_constraints(spark.createDataFrame(held, RULE), spark.createDataFrame(asked, REQUEST)).collect())
    assert got == sorted((r[0], c[0]) for c in held for r in asked if applies(c, r))
    assert rules.check_constraints(spark.createDataFrame([], RULE), spark.createDataFrame(asked, REQUEST)).where("blocked").count() == 0


def test_ten_thousand_constraints_and_requests(spark):
    held = [(k, f"s{k % 9}" if k % 3 else "global", f"avoid thing{k % 4000}", json.dumps([f"app{k}.*", f"*.tool{k // 2}"]), "hard", None) for k in range(10_000)]
    asked = [(k, f"s{k % 9}" if k % 11 else None, [f"App{k * 7 % 10_000}.run", f"x.tool{k // 3}"], f"use thing{k % 5000}", None) for k in range(10_000)]
    out = rules.matching_constraints(spark.createDataFrame(held, RULE), spark.createDataFrame(asked, REQUEST))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got: dict = {}
    for r in out.select("request_id", "id").collect():
        got.setdefault(r.request_id, []).append(r.id)
    for r in asked[::500]:
        assert sorted(got.get(r[0], [])) == [c[0] for c in held if applies(c, r)]


CONTRACT = "---\nname: my.tool\ndescription: 'does it'\nexec_path: ~/skills/run.sh\nexec_type: shell\n---\n" + "A body that is long enough to be taken for a contract.\n"


@pytest.mark.parametrize(
    "old, new, error",
    [
        ("", "", None), ("---\nname", "--\nname", "no frontmatter"), ("name: my.tool\n", "", "missing field: name"), ("my.tool", "Tool", "invalid name"), ("shell\n", "perl\n", "invalid exec_type"),
        ("~/skills", "/tmp", "path outside the skills folder"), ("run.sh", "run.js", "script needs node"), ("exec_type: shell", "exec_type: python", "python needs a python file"),
        ("A body", "```\nA body", "odd number of fences"), (" that is long enough to be taken for a contract.", "", "body too short"), ("A body", "read ~/.x/tokens/ A body", "forbidden content"),
    ],
)
def test_contracts(spark, old, new, error):
    rows = spark.createDataFrame([(CONTRACT.replace(old, new, 1) if old else CONTRACT,)], "contract_md string")
    out = rules.validate_contract(rows, "/h/skills/", "/h", ["/tokens/"]).first()
    assert out.error == error and (error == "no frontmatter" or out.fm["description"] == "does it")


def test_file_names(spark):
    row = spark.createDataFrame([("see server.js and A.PDF, a.pdf or qx-report Jan 26 x",)], "t string")
    names = text.file_names(F.col("t"))
    assert row.select(names).first()[0] == ["server.js", "A.PDF", "a.pdf", "qx-report"]
    assert row.select(text.valid_names(names)).first()[0] == ["server.js", "A.PDF", "qx-report"]
    assert text.broken_names("cbs-rep noise chloe.pdf then istian.pdf") == ["cbs-rep...chloe.pdf", "cbs-rep...istian.pdf"]
    assert text.broken_names("a-b " + "x " * 120 + "far.pdf") == []


def test_gibberish():
    assert text.without_gibberish("Meeting at 10:30 AM a b c d e about budget", ["At"]) == "Meeting at 10:30 AM --- about budget"
    assert text.without_gibberish("xq rbd zz kk vf bd real sentence follows") == "follows"
    assert text.without_gibberish("xq SDK zz kk vf bd real sentence", ["sdk", "real", "sentence"]) == "SDK --- real sentence"
    assert text.without_gibberish("keep report-two.pdf and 2024-01-02 times") == "keep report-two.pdf and 2024-01-02 times"
    assert text.without_gibberish(None) == "" and text.without_gibberish("rbd hello", ["rbd"]) == "rbd hello"


def test_overlay_products_are_given(spark):
    row = spark.createDataFrame([("Acme Helper window",)], "t string")
    assert row.select(text.overlay_tainted(F.col("t")), text.overlay_tainted(F.col("t"), ["acme helper"])).first()[:] == (False, True)


def test_hash_and_embedding():
    assert embedding.word_hash("hello") == 99162322 and embedding.word_hash("polygenelubricants") == -(2**31)
    v = embedding.hashed_embedding("some text, some more")
    assert len(v) == 384 and np.isclose(np.linalg.norm(v), 1) and np.allclose(v, embedding.hashed_embedding("some text, some more"))


def test_bad_vectors_are_refused(spark):
    texts = spark.createDataFrame([("good",), ("bad",), ("good",)], "text string")
    out = embedding.embed_distinct(texts, lambda own: [[1.0, 2.0] if t == "good" else [float("nan"), 1.0] for t in own], 2)
    assert {r.text: r.embedding for r in out.collect()} == {"good": [1.0, 2.0], "bad": None}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(sorted(folds.DELTAS)), min_size=1, max_size=60))
def test_mood_fold(spark, kinds):
    v = a = 0.0
    for k in kinds:
        dv, da = folds.DELTAS[k]
        v, a = (v * 0.98, a * 0.98) if k == "natural_decay" else (v + dv, a + da)
        v, a = max(-1.0, min(1.0, v)), max(-1.0, min(1.0, a))
    events = spark.createDataFrame([(1, i, i, k) for i, k in enumerate(kinds)], "user long, ts long, event_id long, event_type string")
    got = folds.mood(events, "user").first()
    assert got.valence == pytest.approx(v) and got.arousal == pytest.approx(a) and got.hurt_count == kinds.count("user_insult")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=1, max_size=40), st.sampled_from([0.1, 0.5, 1.0]))
def test_moving_average(spark, values, alpha):
    want = values[0]
    for x in values[1:]:
        want = want * (1 - alpha) + x * alpha
    rows = spark.createDataFrame([(1, i, [x, -x]) for i, x in enumerate(values)], "k long, ts long, features array<double>")
    got = folds.moving_average(rows, "k", alpha=alpha).first()
    assert got.features == pytest.approx([want, -want]) and got.sample_count == len(values)


def test_gates_of_a_busy_user(spark):
    """All rows of one user, over many hours and tasks, against a plain loop; null users, hours without a real app, equal texts over a boundary."""
    from datetime import timedelta

    r = random.Random(7)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(1200):
        at += timedelta(seconds=r.choice([5, 30, 600, 4000]))
        rows.append((at, i, r.choice(["busy"] * 8 + [None, "b"]), r.choice(["Code", "Electron", "Electron Helper"]), r.choice("xy"), r.choice([100, 150, 400, None]), 5, r.choice(["text one", "text two"])))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, capture_id long, user_id string, app string, title string, width int, height int, ocr_raw string").repartition(6)
    changed, resized, texts, apps, before, real = {}, set(), set(), {}, {}, {}
    for t, i, user, app, title, width, height, ocr in rows:
        old = before.get(user)
        changed[i] = old is None or (old[3], old[4]) != (app, title)
        if old and width is not None and old[5] is not None and abs(width - old[5]) > 100:
            resized.add(i)
        if not old or old[7] != ocr:
            texts.add(i)
        if "Electron" not in app:
            real[user] = app
        apps[i] = real.get(user)
        before[user] = (t, i, user, app, title, width, height, ocr)
    assert {x.capture_id: x.changed for x in stream.title_changes(df).collect()} == changed
    assert {x.capture_id for x in stream.resizes(df).collect()} == resized
    assert {x.capture_id for x in stream.drop_repeats(df).collect()} == texts
    assert {x.capture_id: x.real_app for x in stream.last_real_app(df).collect()} == apps
    assert stream.title_changes(df).columns == [*df.columns, "changed"] and stream.drop_repeats(df).columns == df.columns
    tasks = stream.drop_repeats(df.where("user_id = 'busy'")).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_folds_of_many_segments(spark, monkeypatch):
    """Segments of three events and several levels, keys of all lengths, a null key, samples of other lengths than the first."""
    monkeypatch.setattr(folds.in_segments, "__defaults__", (3,))
    r = random.Random(6)
    events = [(r.choice([1, 1, 1, 2, 3, None]), i // 3, i, r.choice([*folds.DELTAS, "unknown"])) for i in range(400)] + [(9, 0, 0, "user_insult")]
    want, counts = {}, {}
    for user, _, _, kind in events:
        if kind in folds.DELTAS:
            v, a = want.get(user, (0.0, 0.0))
            dv, da = folds.DELTAS[kind]
            v, a = (v * (1 - folds.DECAY), a * (1 - folds.DECAY)) if kind == "natural_decay" else (v + dv, a + da)
            want[user] = max(-1.0, min(1.0, v)), max(-1.0, min(1.0, a))
            counts[user] = counts.get(user, 0) + (kind == "user_insult")
    df = spark.createDataFrame(events, "user long, ts long, event_id long, event_type string").repartition(5)
    got = {m.user: m for m in folds.mood(df, "user").collect()}
    assert set(got) == set(want) and {k: m.hurt_count for k, m in got.items()} == counts
    for k, (v, a) in want.items():
        assert got[k].valence == pytest.approx(v, abs=1e-9) and got[k].arousal == pytest.approx(a, abs=1e-9)
    samples = [(r.choice([1, 2, 2, None]), i, [r.uniform(-5, 5) for _ in range(r.choice([1, 2, 2, 3]))]) for i in range(200)]
    state = {}
    for k, _, x in samples:
        own = state.get(k)
        state[k] = x if own is None else [v * 0.9 + (x[i] if i < len(x) else 0.0) * 0.1 for i, v in enumerate(own)]
    got = {m.k: m for m in folds.moving_average(spark.createDataFrame(samples, "k long, ts long, features array<double>").repartition(4), "k").collect()}
    assert set(got) == set(state) and all(got[k].features == pytest.approx(v) for k, v in state.items())


def test_folds_of_one_long_key(spark):
    """A million events of one key, in segments over all tasks."""
    kinds = list(folds.DELTAS)
    events = spark.range(1_000_000).select(F.lit(1).alias("user"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.element_at(F.lit(kinds), (F.pmod(F.xxhash64("id"), F.lit(len(kinds))) + 1).cast("int")).alias("event_type"))
    v = a = 0.0
    for (kind,) in events.select("event_type").toPandas().itertuples(index=False):
        dv, da = folds.DELTAS[kind]
        v, a = (v * 0.98, a * 0.98) if kind == "natural_decay" else (v + dv, a + da)
        v, a = max(-1.0, min(1.0, v)), max(-1.0, min(1.0, a))
    got = folds.mood(events, "user").first()
    assert got.valence == pytest.approx(v, abs=1e-9) and got.arousal == pytest.approx(a, abs=1e-9)
    samples = events.select("user", "ts", F.array((F.col("ts") % 7).cast("double")).alias("features"))
    state = 0.0
    for i in range(1, 1_000_000):
        state = state * 0.9 + (i % 7) * 0.1
    assert folds.moving_average(samples, "user").first().features == pytest.approx([state])


def test_overlay_text(spark):
    state = spark.createDataFrame([(0.2, 0.0, None)], "valence double, arousal double, mood_label string")
    traits = spark.createDataFrame([("user_interests", "maps"), ("user_projects", ""), ("speaker_profile", "male_adult")], "trait_key string, trait_value string")
    lines = folds.overlay(state, traits).first().overlay.split("\n")
    assert lines[3] == "Mood: content (valence: 0.20, arousal: 0.00)" and "User interests: maps" in lines and not any("projects" in x for x in lines)
    assert lines[-2] == 'Speaker profile: male adult — address as "sir" when appropriate'


def test_shared_folder_must_be_named_on_a_cluster():
    """Without spark.checkpoint.dir only a local session gets a temporary folder."""
    from types import SimpleNamespace as Stub

    from engram.storage import shared_dir

    def session(master, named):
        return Stub(conf=Stub(get=lambda key, default: named), sparkContext=Stub(getConf=lambda: {}, master=master, applicationId="stub"))

    assert shared_dir(session("spark://host:7077", "s3://bucket/folder/")) == "s3://bucket/folder"
    assert shared_dir(session("local[2]", None)).startswith("file:")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None))


def test_settled_phases_are_removed(spark):
    """Only the settled frame's folder is left of what was written on the way."""
    import os

    from engram.storage import materialize, settle, shared_dir

    root = shared_dir(spark).removeprefix("file:").replace("//", "/") + "/engram"

    def make():
        return materialize(materialize(spark.range(5), "first"), "second").where("id > 1")

    out = settle(spark, "kept", make)
    left = [f for f in os.listdir(root) if f.startswith(("first", "second", "kept"))]
    assert out.count() == 3 and len(left) == 1 and left[0].startswith("kept")


@pytest.mark.parametrize(("word", "odd"), [("a.pdf", False), ("ab-cd", False), ("x-y", True), ("x12", False), ("12", False), ("ab", True), ("brr", True), ("strip", True), ("string", False), ("lengths", True), ("word", False), ("...", False), ("", False)])
def test_odd_words(word, odd):
    assert text.odd_word(word) == odd


def test_broken_names_in_long_texts():
    """Against every pair of beginnings and names, and in time on a long text."""

    def brute(t):
        heads = [(m.group(1), m.end()) for m in re.finditer(r"([a-zA-Z0-9]+-[a-zA-Z0-9-]*[a-zA-Z0-9]|[a-zA-Z0-9]+-)(?=\s)", t)]
        tails = [(m.group(1), m.start()) for m in re.finditer(r"(?i)([a-zA-Z0-9][a-zA-Z0-9_-]*\.(?:pdf|py|md))", t)]
        taken, out = set(), []
        for h, e in heads:
            for n, b in tails:
                if b not in taken and 0 < b - e < 200:
                    taken.add(b)
                    out.append(f"{h}...{n}")
        return out

    r = random.Random(1)
    for _ in range(200):
        t = " ".join(r.choice(["ab-cd", "q-", "x.pdf", "long_name.py", "word", "y" * 90, "z-1.md"]) for _ in range(r.randrange(60)))
        assert text.broken_names(t) == brute(t)
    start = time.perf_counter()
    assert len(text.broken_names("ab-cd x.pdf " * 40_000)) == 40_000 and time.perf_counter() - start < 5


def test_common_words(spark):
    rows = spark.createDataFrame([("the SDK is", 1), ("the sdk", 2), ("the rare", 3), (None, 4)], "t string, i int")
    assert text.common_words(rows, "t", 0.5) == {"the", "sdk"} and text.common_words(rows, "t", 0.0, 1) == {"the"}


def test_nearest_rank_against_sorted_values(spark):

    from engram.operators import upkeep

    r = random.Random(2)
    rows = [(k, r.choice([r.uniform(-5, 5), 1.5, 1.5000001, 1e9, None])) for k in ("a", "b") for _ in range(500)] + [("c", 7.0), ("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = (0.01, 0.5, 0.95, 0.99, 1.0)
    values = {k: sorted(v for q, v in rows if q == k and v is not None) for k in "abc"}
    at = lambda v: tuple(v[max(0, math.ceil(s * len(v)) - 1)] for s in shares)
    for pieces in (2, 4096):
        assert {x.k: tuple(x)[1:] for x in upkeep.nearest_rank(frame, "v", *shares, by="k", pieces=pieces).collect()} == {k: at(v) for k, v in values.items()}
    assert tuple(upkeep.nearest_rank(frame, "v", *shares).first()) == at(sorted(v for _, v in rows if v is not None))


def test_lookups_of_many_blocks(spark):
    """Text ids, several blocks of queries, ties and the row itself left out, against one product."""
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 8))
    v[10] = v[11]
    rows = spark.createDataFrame([(f"r{i:02}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, embedding array<double>")
    asked = rows.selectExpr("id AS query_id", "embedding AS query_embedding")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(n @ n.T, 6)
    for block in (7, 2048):
        for others in (False, True):
            got = {(x.query_id, x.id, round(x.similarity, 5)) for x in search.lookup_many(rows, asked, -1.0, limit=3, block=block, others_only=others).collect()}
            want = set()
            for q in range(60):
                order = sorted((i for i in range(60) if not (others and i == q)), key=lambda i: (-sims[i, q], i))[:3]
                want |= {(f"r{q:02}", f"r{i:02}", round(float(sims[i, q]), 5)) for i in order}
            assert got == want


def test_manifests_say_yes_only_with_a_true(spark):
    from engram.operators import registry

    skills = spark.createDataFrame([(n,) for n in "abcdef"], "name string")
    files = spark.createDataFrame([("a", '{"goal_tied": true}'), ("b", '{"goal_tied": "true"}'), ("c", "{"), ("d", '{"x": 1}'), ("e", None)], "name string, manifest string")
    assert {r.name: r.goal_tied for r in registry.with_manifests(skills, files).collect()} == {n: n == "a" for n in "abcdef"}


def test_listing_takes_only_given_filters(spark):
    from engram.operators import registry

    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 7.0)], "id long, k string, w double")
    ids = lambda *args, **more: [r.id for r in registry.listing(df, *args, **more).collect()]
    assert ids({}) == [1, 2, 3] and ids({"k": None}, F.desc("id")) == [3, 2, 1] and ids({"k": "a"}) == [1]
    assert ids({"k": ["a", "b"]}, at_least={"w": 5.0}) == [1] and ids({"k": []}) == []


def test_install_keeps_enabled_and_refuses(spark):
    from engram.operators import registry

    kind = "name string, id long, enabled boolean, updated_at timestamp_ntz"
    base = spark.createDataFrame([("a", 1, False, NOW), ("b", 2, True, NOW)], kind)
    new = spark.createDataFrame([("a", 3, NOW, None), ("c", 4, NOW, None), ("b", 5, NOW, "bad")], "name string, id long, updated_at timestamp_ntz, error string")
    after, refused = registry.install_skills(base, new)
    assert {r.name: (r.id, r.enabled) for r in after.collect()} == {"a": (3, False), "b": (2, True), "c": (4, True)} and [r.id for r in refused.collect()] == [5]


def test_maintenance_runs_when_due_or_stopping(spark):
    from datetime import timedelta

    rows = spark.createDataFrame([(1, datetime(2010, 1, 1)), (2, datetime(2020, 1, 1))], "id long, created_at timestamp_ntz")
    children = spark.createDataFrame([(1,), (2,)], "memory_id long")
    left = lambda last, **more: ([r.id for r in upkeep.maintain(rows, children, last, NOW, **more)[0].collect()], upkeep.maintain(rows, children, last, NOW, **more)[2])
    early = NOW - timedelta(hours=23)
    assert left(early) == ([1, 2], early) and left(early, stopping=True) == ([2], NOW) == left(None) == left(NOW - timedelta(hours=24))
    assert [r.id for r in upkeep.purge_older(rows, children, datetime(2021, 1, 1), 3000)[0].collect()] == [2]


def test_screen_text_chain(spark):
    raw = "see  report-two.pdf\nconst a = 1\n[INFO] xq zz kk vf bd rbd budget meeting about plans"
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    one, none = df.select(*(c.alias(k) for k, c in text.screen_text(F.col("t"), ["see"]).items())).collect()
    assert one.files == ["report-two.pdf"] and one.snippets == ["const a = 1"] and "report-two" not in one.filtered and one.filtered == "see --- about plans" and none.filtered == ""


def test_names_are_those_of_the_plain_patterns(spark):
    """Linear patterns find what the plain ones find."""
    r = random.Random(1)
    parts = ["a", "B", "9", "-", "-", "_", ".", "/", " ", "  ", "\n", ".js", ".json", ".md", "Jan ", "May ", "ab", " Feb "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)]
    ext, months = "|".join(text.EXTENSIONS), "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    plain = re.compile(rf"[a-z0-9][a-z0-9._/-]*\.(?:{ext})\b", re.IGNORECASE | re.ASCII)
    dated = re.compile(rf"([a-z][a-z0-9]+-[a-z0-9-]+[a-z0-9])\s+(?:{months})\s", re.IGNORECASE | re.ASCII)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = {x.t: x.n for x in rows.select("t", text.file_names(F.col("t")).alias("n")).collect()}
    assert got == {t: list(dict.fromkeys(plain.findall(t) + dated.findall(t))) for t in texts}
    for files in [["a.md", "A.MD", "b.md", "a.md"], [], ["x/y.md", "b.md", "B.md", " "]]:
        one = spark.createDataFrame([(files,)], "f array<string>")
        firsts = [n for k, n in enumerate(files) if n.lower() not in [x.lower() for x in files[:k]]]
        assert one.select(text.valid_names(F.col("f"))).first()[0] == [n for n in firsts if n in ("a.md", "b.md")]


@pytest.mark.parametrize("unit", ["a", "a-", "a.", "ab-", "a9", "1-", "Zm9v"])
def test_names_in_long_runs(spark, unit):
    """A million characters of one run take no longer than other texts."""
    long = (unit * 1_000_000)[:1_000_000]
    one = spark.createDataFrame([(long,)], "t string")
    one.select(F.size(text.file_names(F.col("t")))).collect()
    for run in (lambda: text.broken_names(long), lambda: text.without_gibberish(long), lambda: one.select(F.size(text.valid_names(text.file_names(F.col("t"))))).collect()):
        start = time.perf_counter()
        run()
        assert time.perf_counter() - start < 5


def test_common_words_at_the_cap(spark):
    """Where more words are common than may be kept, those in the most texts stay, ties by the word."""
    rows = spark.createDataFrame([("bb cc aa",), ("bb cc aa",), ("bb",)], "t string")
    assert text.common_words(rows, "t", 0.5, 2) == {"bb", "aa"} and text.common_words(rows, "t", 0.5, 3) == {"bb", "aa", "cc"}
