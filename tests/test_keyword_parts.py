"""The keyword index counts a text once and deals long lists to several parts."""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from engram.operators import keyword_index
from engram.operators.keyword_index import KeywordIndex

TEXTS = {k: f"the of w{'abcdefghij'[k % 10] * (1 + k % 13)} THE, x{'yz' * (k % 7)}é9 Ünder {k}" for k in range(1500)} | {1500: None, 1501: "", 1502: "é 9", 1503: "ab"}


def test_texts_are_counted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SAMPLE", 50, raising=False)
    asked = spark.sparkContext.accumulator(0)

    def told(text):
        asked.add(1)
        return text

    rows = spark.createDataFrame(list(TEXTS.items()), "id long, source_text string").repartition(3)
    KeywordIndex(spark, str(tmp_path / "i")).refresh(rows.withColumn("source_text", F.udf(told, "string")("source_text")))
    assert len(TEXTS) <= asked.value < 1.2 * len(TEXTS)


def test_lists_over_several_parts(spark, tmp_path, monkeypatch):
    """Against plain counts; parts are sorted by term, and lists longer than a part lie in several."""
    for name, value in (("PART", 700), ("SAMPLE", 400), ("_SLICE", 3000)):
        monkeypatch.setattr(keyword_index, name, value)
    rows = spark.createDataFrame([*TEXTS.items(), (None, "lost")], "id long, source_text string")
    want = set()
    for k, text in TEXTS.items():
        words = re.findall("[a-z]+", (text or "").lower())
        want |= {(t, k, n, len(words)) for t, n in [("", 0), *Counter(words).items()]}
    got = [(r.part, r.term, r.id, r.tf, r.length) for r in keyword_index.sorted_postings(rows).withColumn("part", F.spark_partition_id()).collect()]
    assert len(got) == len(want) and {r[1:] for r in got} == want
    ends = {}
    for p in sorted({r[0] for r in got}):
        terms = [r[1] for r in got if r[0] == p]
        assert terms == sorted(terms) and len(terms) < 3 * 700
        ends[p] = (terms[0], terms[-1])
    assert len(ends) > 5 and len({r[0] for r in got if r[1] == "the"}) > 1
    assert all(a[1] <= b[0] or len({r[0] for r in got if r[1] == b[0]}) > 1 for a, b in zip(list(ends.values()), list(ends.values())[1:]))
    index = KeywordIndex(spark, str(tmp_path / "i"))
    index.refresh(rows)
    assert sorted(r.id for r in index.ids().collect()) == sorted(TEXTS)


def test_words_of_slices():
    texts = pa.array([None, "ab", "cd", "", "e f", "é", "aéb", "zz"])
    for a in range(len(texts)):
        words, at = keyword_index.words_of(texts.slice(a))
        plain = [(w, i) for i, t in enumerate(texts.to_pylist()[a:]) for w in re.findall("[a-z]+", t or "")]
        assert list(zip(words.to_pylist(), at.tolist())) == plain
