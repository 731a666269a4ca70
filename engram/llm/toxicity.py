"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled documents: word beginnings (and whole words) that stand in many
more toxic documents than others. Features of a text are densities of lexicon words, their nearness
to second-person words, capitals, punctuation and obfuscation rates, and the like. Lexicon, trees and
calibration are fitted on different parts of a sample of at most MOST_ROWS labelled rows whose ids
pass the train test; nothing but text enters a score.

Defined results: a null or empty text has the score of a text without words; without any labelled
row all scores are 0; equal ids among the labels count once, toxic if any says so; a null id is not
held out; equal rows each get their own result; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import boosting
from engram.llm.arrow import map_arrow
from engram.storage import materialize

#: Labelled rows that are fitted on at most, lexicon entries kept, and the score from which a text is toxic.
MOST_ROWS, MOST_ENTRIES, THRESHOLD = 8000, 4000, 0.5
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
#: Fewer rows than this are not split between lexicon, trees and calibration.
LEAST_SPLIT = 400

#: Words that address the reader, in English, German, French and Spanish.
SECOND = frozenset("you your yours yourself ur u du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Insults that are known beforehand (English); the learned lexicon adds to them.
KNOWN = frozenset("idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb fool garbage vermin filth jerk creep imbecile".split())
#: Signs often put for letters.
_LEET = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)[.,;:]*[^\W\d_]+[\d@$!*]+[^\W\d_]+[.,;:!?]*(?!\S)")
_NEAR, _WINDOW = 5, 50
FEATURES = 22


def stems(word: str) -> list[str]:
    """A word's lexicon keys: beginnings, and the word itself marked as whole."""
    return [*(word[:k] for k in STEMS if len(word) >= k), word + "$"]


class Lexicon:
    """Weights of words; a memo of bounded size."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.memo: dict[str, float] = {}

    def weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            got = max((self.weights.get(s, 0.0) for s in stems(word)), default=0.0)
            if word in KNOWN:
                got = max(got, 3.0)
            if len(self.memo) >= 300_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def of(self, words: list[str]) -> list[float]:
        try:
            return list(map(self.memo.__getitem__, words))
        except KeyError:
            return list(map(self.weight, words))

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "memo": {}}


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a text."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(1, len(text))
    capital, letters = int(counts[65:91].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    weights = lexicon.of(words)
    at = [i for i, w in enumerate(weights) if w > 0]
    strong = [i for i in at if weights[i] >= 2.5]
    you = [i for i, w in enumerate(words) if w in SECOND]
    near, k = 0, 0
    for i in strong:
        while k < len(you) and you[k] < i - _NEAR:
            k += 1
        near += k < len(you) and you[k] <= i + _NEAR
    most = j = 0
    for i in range(len(strong)):
        while strong[i] - strong[j] >= _WINDOW:
            j += 1
        most = max(most, i - j + 1)
    mixed = _MIXED.findall(text) if counts[[36, 42, 64, 33, *range(48, 58)]].sum() else []
    plain = [w for x in mixed for w in _WORD.findall(x.lower().strip(".,;:!?").translate(_LEET))]
    hidden = sum(w >= 2.5 for w in lexicon.of(plain))
    per = max(1, n)
    return [
        len(strong) / per,
        math.log1p(len(strong)),
        len(at) / per,
        math.log1p(len(at)),
        sum(weights) / per,
        max(weights, default=0.0),
        float(len({words[i] for i in strong})),
        float(most),
        near / per,
        near / max(1, len(strong)),
        len(you) / per,
        capital / max(1, letters),
        capital / chars,
        counts[33] / chars,
        counts[63] / chars,
        text.count("!!") / chars,
        counts[[35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]].sum() / chars,
        len(mixed) / per,
        hidden / per,
        math.log1p(n),
        letters / chars,
        counts[48:58].sum() / chars,
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Trees | None
    shares: boosting.Isotonic | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(self.shares(self.trees.raw(x)), 0.0, 1.0)


def held_out(column: Column) -> Column:
    """Whether a row's id keeps its label from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_ROWS) -> DataFrame:
    """part, text and toxic of at most ``most`` labelled rows outside the held-out fifth, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = known.groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("train"))
    chosen = chosen.withColumn("turn", order).orderBy("turn", id_col).limit(most)
    chosen = chosen.select(F.col(id_col).alias("chosen_id"), "toxic", F.pmod("turn", F.lit(20)).cast("int").alias("part"))
    plain = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"))
    rows = plain.join(F.broadcast(chosen), F.col("own_id") == F.col("chosen_id"))  # ``most`` rows of three numbers
    return rows.select("part", "text", "toxic")


def learn_lexicon(rows: DataFrame, most: int = MOST_ENTRIES) -> dict[str, float]:
    """Log odds ratios of word beginnings that are far more common in toxic documents; the strongest ``most``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for s in {s for w in set(_WORD.findall((text or "").lower())) for s in stems(w)}:
                sums.setdefault(s, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["stem", "clean", "toxic"])

    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return {}
    sums = map_arrow(rows.select("text", "toxic"), run, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    least = max(3, math.ceil(0.01 * bad))
    strong = sums.where(F.col("toxic") >= least).withColumn("weight", weight).where("weight >= 1.5")
    ranked = strong.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "stem").limit(most)
    return {r.stem: float(r.weight) for r in ranked.select("stem", "weight").collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_ROWS) -> Model:
    """Fit lexicon, trees and calibration; the sample's features (``most`` rows) come to the driver."""
    rows = materialize(training_rows(docs, labels, id_col, text_col, label_col, most), "labelled")
    n = rows.count()
    if not n:
        return Model(Lexicon({}), None, None)
    split = n >= LEAST_SPLIT
    lexicon = Lexicon(learn_lexicon(rows.where("part < 10") if split else rows))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["part", "toxic", "x"])

    got = map_arrow(rows.where("part >= 10").select("text", "part", "toxic") if split else rows.select("text", "part", "toxic"), run, "part int, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r.part, r.toxic, r.x))
    x, y, part = np.array([r.x for r in got]).reshape(len(got), FEATURES), np.array([r.toxic for r in got], float), np.array([r.part for r in got])
    grown, held = (part < 16, part >= 16) if split else (np.ones(len(y), bool),) * 2
    trees = boosting.fit(x[grown], y[grown])
    return Model(lexicon, trees, boosting.calibrate(trees.raw(x[held]), y[held]))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = model.score(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    wanted = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(wanted, run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text in column text) that are not predicted toxic."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = model.score(batch.column(batch.schema.get_field_index("text")).to_pylist())
        yield batch.filter(pa.array(score < THRESHOLD))

    return map_arrow(docs, run, docs.schema)
