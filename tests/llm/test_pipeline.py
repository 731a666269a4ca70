"""The corpus pipeline against stages done by hand."""

import hashlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from engram.llm import bpe, secret_scan, toxicity

from .fixtures import awkward
from .test_copies import similar_brute
from .test_filters import contamination_brute


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "byte_level_bpe"]
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def by_hand(docs, items, model):
    kept = [d for d in docs if model.score([d.text])[0] < toxicity.THRESHOLD]
    group = similar_brute([d.text for d in kept])
    kept = [d for i, d in enumerate(kept) if group[i] == i]
    kept = [d for d in kept if not contamination_brute(d.text, items)[-1]]
    codec = bpe.Codec.of(bpe.RANKS, bpe.PATTERN)
    out = Counter()
    for d in kept:
        text = secret_scan.masked(d.text) or ""
        ids = np.array(codec.library.encode_ordinary(text), "<u4")
        out[(d.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def small_benchmark(spark, docs):
    """Two passages of the documents, so that the brute force stays small."""
    long = [d for d in docs if d.text and len(d.text.split()) > 60][:2]
    return [(i, " ".join(d.text.split()[5:25])) for i, d in enumerate(long)]


def test_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120)
    rows = docs.collect()
    items = small_benchmark(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.train(docs, labels)
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == by_hand(rows, items, model) and 0 < sum(got.values()) < len(rows)


def test_stages_awkward(spark, sf_dir):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count(), name
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_stages_empty(spark, sf_dir):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
