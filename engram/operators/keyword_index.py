"""A kept keyword index: postings written once for each text, asked by many queries without reading any text.

Tables of a part: ``postings`` (term, id, tf, length), in files that are sorted by term, so that a term's list is found by the files'
statistics; a long list is cut by a hash of the id over many files. The list of the empty term holds every row of the part, those without words
too. ``lists`` (term, docs, words) is what a query needs to know of a list before it reads it. ``gone`` (id)
takes rows of earlier parts away; its part's ``lists`` then count downwards.

Terms, corpus figures and scores are those of ``search.bm25``. Defined results: a null or empty text counts as a row without words;
rows without an id are left out; an id that stands twice among new rows is refused with ValueError; queries without terms, or with terms
that no row holds, give no rows; repeated queries of one id are taken together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from engram.functions import ranking
from engram.operators import kept
from engram.operators.filters import best_per
from engram.storage import materialize

#: Bytes of text that are counted at once, about.
_SLICE = 1 << 22
#: Postings in a part of new ones, about; parts at most; rows that tell their ranges, about; letters of a term that tell its range; terms a part that are looked at.
PART, MOST_PARTS, SAMPLE, _LETTERS, _TOLD = 1_000_000, 8192, 2048, 8, 32
#: Up to so many distinct terms are named to the scan of the postings; more meet it in a join alone.
NAMED_TERMS = 2048
#: Rows of the table in a shard, about, and queries that meet a shard at once.
SHARD, BLOCK = 4096, 2048
#: Scores are told to four digits; lists are left only where they cannot change any of them.
DIGITS, _SLACK = 4, 1e-4
_LISTS = StructType().add("term", StringType()).add("docs", LongType()).add("words", LongType())


def _postings_type(kind: DataType) -> StructType:
    return StructType().add("term", StringType()).add("id", kind).add("tf", LongType()).add("length", LongType())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z in texts, and the place of the text that each stands in."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = held - np.uint8(97) < 26  # bytes of other characters are never among these
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = ends[:-1][ends[:-1] < len(held)]
    first[begins] = letter[begins]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    starts = np.flatnonzero(first)
    cuts = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(held[letter]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))


def _leading(terms: pa.Array) -> np.ndarray:
    """The first _LETTERS letters of terms as numbers of the same order."""
    terms = terms.cast(pa.large_string())
    cuts = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    held = np.append(np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.uint8(0))
    out = np.zeros(len(terms), np.uint64)
    for k in range(_LETTERS):
        at = cuts[:-1] + k
        out = out << np.uint64(8) | np.where(at < cuts[1:], held[np.minimum(at, len(held) - 1)], 0).astype(np.uint64)
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First place and number of rows of slices with some _SLICE bytes of text, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _SLICE, side="right")))
        yield a, b - a
        a = b


def count_terms(rows: DataFrame, bounds: list[str], text_col: str = "source_text") -> DataFrame:
    """Each row's terms, and the empty term once a row, packed: part, term, and the ids, counts and lengths of rows of a slice.

    ``bounds`` are the ends of the parts' ranges of terms, told by first letters; terms that are the end of several are dealt to them by a hash of the id.
    """
    schema = StructType().add("part", IntegerType()).add("term", StringType()).add("ids", ArrayType(rows.schema["id"].dataType)).add("tfs", ArrayType(IntegerType())).add("lengths", ArrayType(IntegerType()))
    limits = _leading(pa.array(bounds, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in _slices(batch.column(2)):
                own = batch.slice(a, n)
                words, at = words_of(own.column(2))
                coded = words.dictionary_encode()
                keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + at, return_counts=True)
                term, row = np.concatenate([np.zeros(n, np.int64), keys // n + 1]), np.concatenate([np.arange(n), keys % n])
                tf, length = np.concatenate([np.zeros(n, np.int64), tf]), np.bincount(at, minlength=n)
                names = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string())])
                told = _leading(names)
                low, high = np.searchsorted(limits, told), np.searchsorted(limits, told, side="right")
                part = low[term] + own.column(1).to_numpy()[row] % (high - low + 1)[term]
                order = np.lexsort((part, term))
                term, part, row, tf = term[order], part[order], row[order], tf[order]
                begins = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])))
                cuts = pa.array(np.append(begins, len(term)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, v) for v in (own.column(0).take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(part[begins].astype(np.int32)), names.take(pa.array(term[begins])), *lists], names=schema.names)

    return rows.where("id IS NOT NULL").select("id", F.xxhash64("id"), F.lower(F.col(text_col))).mapInArrow(run, schema)


def range_bounds(rows: DataFrame, text_col: str = "source_text") -> list[str]:
    """Ends of ranges of terms, in order, with some PART postings each: told by about SAMPLE rows, chosen by a hash of the id."""
    every = max(1, math.ceil(rows.count() / SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("bounds")), F.lit(every)) == 0)
    words = F.explode(F.array_union(F.array(F.lit("")), F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z]+")))
    told = materialize(some.select("id", words.alias("term")).select(F.substring("term", 1, _LETTERS).alias("term"), F.xxhash64("id", "term").alias("turn")), "bounds")
    held = told.count()
    parts = min(MOST_PARTS, math.ceil(held * every / PART))
    if parts < 2:
        return []
    terms = sorted(r.term for r in told.where(F.pmod("turn", F.lit(max(1, held // (_TOLD * parts)))) == 0).select("term").collect())  # some _TOLD a part
    return [terms[k * len(terms) // parts] for k in range(1, parts)] if terms else []


def sorted_postings(rows: DataFrame, text_col: str = "source_text") -> DataFrame:
    """term, id, tf and length of the rows' terms, in parts by ranges of terms, each sorted by term.

    A text is counted once: the ranges are fitted on a few rows before, and what moves are packed lists.
    """
    bounds = range_bounds(rows, text_col)
    packed = count_terms(rows, bounds, text_col).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("term")
    flat = packed.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).toDF("term", "id", "tf", "length")
    return flat.withColumns({"tf": F.col("tf").cast("long"), "length": F.col("length").cast("long")})


def _figures(postings: DataFrame) -> DataFrame:
    """What ``lists`` says of postings."""
    return postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("length").alias("words"))


class KeywordIndex:
    """The index kept in a folder that driver and executors share; ``kind`` is the type of its ids."""

    def __init__(self, spark: SparkSession, folder: str, kind: DataType | None = None):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind or LongType()

    def _postings(self, seen: tuple[int, list[list]], wanted: Column | None = None) -> DataFrame:
        """Postings of rows that were not taken away, with the part v."""
        held = kept.read(self.spark, self.folder, "postings", _postings_type(self.kind), seen[1])
        held = held if wanted is None else held.where(wanted)
        if not any("gone" in tables for _, tables in seen[1]):
            return held
        gone = kept.read(self.spark, self.folder, "gone", StructType().add("id", self.kind), seen[1]).groupBy(F.col("id").alias("gone_id")).agg(F.max("v").alias("gone_v"))
        return held.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("v") < F.col("gone_v")), "left_anti")

    def ids(self) -> DataFrame:
        """The ids that the index holds."""
        return self._postings(kept.state(self.spark, self.folder), F.col("term") == "").select("id")

    def refresh(self, rows: DataFrame, gone: DataFrame | None = None, text_col: str = "source_text") -> str:
        """Take away the rows of ``gone`` (id), then add the rows whose id is not held; one commit. The name of the part.

        Texts of rows that are held are not counted again; a changed row is named in ``gone`` and comes with its new text.
        """
        seen = kept.state(self.spark, self.folder)
        held = self._postings(seen)
        known = held.where("term = ''").select("id")
        given = rows.select("id", text_col).where("id IS NOT NULL")
        if gone is not None:
            gone = materialize(known.join(gone.select("id"), "id", "left_semi"), "gone")
            known = known.join(gone, "id", "left_anti")
        if seen[1]:
            fresh = materialize(given.select("id").join(known, "id", "left_anti"), "fresh")  # ids alone are compared
            given = given.join(fresh.distinct(), "id", "left_semi")

        def make(write) -> None:
            counted = write("postings", sorted_postings(given, text_col))
            if counted.where("term = ''").groupBy("id").count().where("count > 1").limit(1).count():
                raise ValueError("an id stands twice among the rows to be added")
            figures = _figures(counted)
            if gone is not None:
                less = _figures(held.join(write("gone", gone), "id", "left_semi"))
                figures = figures.unionByName(less.select("term", (-F.col("docs")).alias("docs"), (-F.col("words")).alias("words")))
            write("lists", figures.repartitionByRange("term").sortWithinPartitions("term"))

        return kept.add(self.spark, self.folder, seen, make)

    def merge(self) -> str:
        """All parts as one, without the rows that were taken away."""
        seen = kept.state(self.spark, self.folder)

        def make(write) -> None:
            whole = write("postings", self._postings(seen).drop("v").repartitionByRange("term", "id").sortWithinPartitions("term", "id"))
            write("lists", _figures(whole).repartitionByRange("term").sortWithinPartitions("term"))

        return kept.add(self.spark, self.folder, seen, make, alone=True)

    def _plan(self, seen: tuple[int, list[list]], queries: DataFrame) -> tuple[DataFrame, Column | None]:
        """query_id, term, docs, all and average of every list that a query asks for, written; and the terms as a filter of the scan."""
        words = F.explode(F.array_distinct(F.split(F.lower("query"), "[^a-z]+"))).alias("term")
        terms = queries.where("query_id IS NOT NULL").select("query_id", words).where("term <> ''").distinct()
        lists = kept.read(self.spark, self.folder, "lists", _LISTS, seen[1])
        whole = lists.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        corpus = whole.where("term = ''").select(F.col("docs").cast("double").alias("all"), (F.col("words") / F.col("docs")).alias("average"))
        known = terms.join(whole.where("docs > 0"), "term").join(F.broadcast(corpus))  # corpus is one row
        plan = materialize(known.select("query_id", "term", "docs", "all", "average"), "plan")
        few = [r.term for r in plan.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        return plan, F.col("term").isin(few) if len(few) <= NAMED_TERMS else None

    def scores(self, queries: DataFrame) -> DataFrame:
        """query_id, id and score of every row that holds a term of a query (query_id, query)."""
        seen = kept.state(self.spark, self.folder)
        plan, wanted = self._plan(seen, queries)
        score = ranking.bm25_term(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("average"), F.col("all"), F.col("docs").cast("double"))
        return self._postings(seen, wanted).join(plan, "term").groupBy("query_id", "id").agg(F.round(F.sum(score), DIGITS).alias("score"))

    def best(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """The ``limit`` best rows of each query; ties by id. The same as the best of ``scores``.

        The lists that queries ask for are dealt once, however many queries ask for them, to shards of some SHARD rows, where every block of up to
        BLOCK queries meets them (``best_of_shard``); a shard gives its best rows a query.
        """
        seen = kept.state(self.spark, self.folder)
        plan, wanted = self._plan(seen, queries)
        sizes = plan.agg(F.max("all").alias("all"), F.count_distinct("query_id").alias("n")).first()
        shards, blocks = max(1, math.ceil((sizes["all"] or 0) / SHARD)), max(1, math.ceil(sizes["n"] / BLOCK))
        plan = plan.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int"))
        figures = plan.groupBy("term", "block").agg(*(F.first(c).alias(c) for c in ("docs", "all", "average")))
        impact = ranking.bm25_term(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("average"), F.col("all"), F.col("docs").cast("double"))
        dealt = self._postings(seen, wanted).join(figures, "term").select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "block", "term", "id", impact.alias("impact"))
        asked = plan.select("query_id", "term", F.col("block").alias("own_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("own_shard"))
        schema = plan.select("query_id").schema.add("id", self.kind).add("score", DoubleType())

        def run(postings: pa.Table, own: pa.Table) -> pa.Table:
            lists = own.group_by("query_id").aggregate([("term", "list")])
            names, wants = lists.column("query_id").combine_chunks(), lists.column("term_list").to_pylist()
            q, ids, scores, _ = best_of_shard(postings.column("term").combine_chunks(), postings.column("id").combine_chunks(), postings.column("impact").to_numpy(), wants, limit)
            return pa.table([names.take(pa.array(q, pa.int64())), ids, pa.array(scores, pa.float64())], names=schema.names)

        near = dealt.groupBy("shard", "block").cogroup(asked.groupBy("own_shard", "own_block")).applyInArrow(run, schema)
        return best_per(near, "query_id", F.desc("score"), F.asc("id"), limit=limit)


def best_of_shard(terms: pa.Array, ids: pa.Array, impacts: np.ndarray, wants: list[list[str]], limit: int) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """Number of the query, id and score of the best ``limit`` rows of each query (a list of terms), and how many entries of lists were gone through.

    A query takes its lists by their largest part of a score. Once the rest together cannot lift a row that is not found yet over
    the last place, the rest is left: rows that still can reach that place are looked up in it, and no other.
    """
    if not len(terms):
        return np.zeros(0, np.int64), ids, np.zeros(0), 0
    held, known = terms.dictionary_encode(), pc.unique(ids)
    known = known.take(pc.sort_indices(known))
    row, term = pc.index_in(ids, known).to_numpy(), held.indices.to_numpy()
    order = np.lexsort((row, term))
    row, impact = row[order], impacts[order]
    ends = np.searchsorted(term[order], np.arange(len(held.dictionary) + 1))
    place = {t: k for k, t in enumerate(held.dictionary.to_pylist())}
    most = np.maximum.reduceat(impact, ends[:-1])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    gone_through = 0
    for q, want in enumerate(wants):
        lists = sorted((place[t] for t in want if t in place), key=lambda k: (-most[k], k))
        rest = np.append(np.cumsum([most[k] for k in lists][::-1])[::-1], 0.0)
        total, floor = np.zeros(len(known)), 0.0
        for n, k in enumerate(lists):
            if floor > rest[n] + _SLACK:
                break
            part = slice(ends[k], ends[k + 1])
            total[row[part]] += impact[part]  # a row stands in a list once
            gone_through += part.stop - part.start
            if len(known) > limit:
                floor = np.partition(total, len(known) - limit)[len(known) - limit]
        else:
            n = len(lists)
        able = np.flatnonzero((total > 0) & (total + rest[n] >= floor - _SLACK))
        score = total[able]
        for k in lists[n:]:
            part = row[ends[k] : ends[k + 1]]
            at = np.minimum(np.searchsorted(part, able), len(part) - 1)
            score = score + np.where(part[at] == able, impact[ends[k] + at], 0.0)
        score = np.round(score, DIGITS)
        first = np.lexsort((able, -score))[:limit]
        out.append((np.full(len(first), q), able[first], score[first]))
    q, at, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return q, known.take(pa.array(at, pa.int64())), scores, gone_through
