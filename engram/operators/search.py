"""Ranked retrieval: nearest vectors, keywords, named entities and recency."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from engram.functions import ranking, vector
from engram.operators import vector_index
from engram.operators.filters import any_ilike, best_per, top
from engram.storage import materialize


def nearest(memories: DataFrame, query: Sequence[float], limit: int = 25, offset: int = 0, digits: int = 6) -> DataFrame:
    """The page of rows with the largest cosine similarity; one top-k pass, no shuffle of the table."""
    scored = memories.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(vector.cosine_to(F.col("embedding"), query), digits))
    return top(scored, F.desc("similarity"), F.asc("id"), limit=limit, offset=offset)


def lookup(rows: DataFrame, query: Sequence[float], threshold: float, limit: int) -> DataFrame:
    """The nearest rows at or above a similarity; the cut is monotone, so it goes before the sort."""
    scored = rows.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(vector.cosine_to(F.col("embedding"), query), 6))
    return top(scored.where(F.col("similarity") >= threshold), F.desc("similarity"), F.asc("id"), limit=limit)


def lookup_many(rows: DataFrame, queries: DataFrame, threshold: float, limit: int = 1, block: int = 2048, others_only: bool = False) -> DataFrame:
    """The nearest rows (query_id, id, similarity) of each query (query_id, query_embedding); ids of any type.

    Up to ``block`` queries go to the tasks as they are; each batch of rows meets them in one matrix product, and only its best
    ``limit`` rows a query go on. More queries than that never come to the driver: rows and queries are dealt to cells and meet
    there (``vector_index.match``), with the same results. ``others_only`` leaves out the row whose id is the query's.
    """
    asked = vector_index.usable(queries.select("query_id", "query_embedding"), "query_embedding")
    few = asked.limit(block + 1).collect()
    if len(few) > block:
        return vector_index.match(rows, queries, threshold, limit, block, others_only)
    able = vector_index.usable(rows.select("id", "embedding"))
    schema = asked.select("query_id").join(able.select("id")).limit(0).withColumn("similarity", F.lit(0.0)).schema
    if not few:
        return rows.sparkSession.createDataFrame([], schema)
    ids = pa.array([r.query_id for r in few], pa_type(asked.schema["query_id"].dataType))
    vectors = vector_index.unit(np.array([r.query_embedding for r in few], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                r, q, sims = vector_index.best_pairs(own.column(0), vector_index.matrix(own.column(1)), ids, vectors, threshold, limit, others_only)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), own.column(0).take(pa.array(r)), pa.array(sims)], names=["query_id", "id", "similarity"])

    return best_per(able.mapInArrow(run, schema), "query_id", F.desc("similarity"), F.asc("id"), limit=limit)


def spaced_words(text: Column) -> Column:
    """The lower-case words of a text, each with a blank of its own on either side; empty without words."""
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def occurrences(text: Column, part: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(float(len(part)))


def query_terms(query: str) -> list[str]:
    """Distinct keyword terms of a query, in order."""
    return list(dict.fromkeys(w for w in re.split("[^a-z]+", query.lower()) if w))


def count_terms(memories: DataFrame, terms: Sequence[str], text_col: str = "source_text", *keep: Column | str) -> DataFrame:
    """id, length in words and how often each term stands in the text (tf0, tf1, ...), beside the columns to keep.

    Small numbers for each row, written once, so that the texts are read in a single pass.
    """
    words = memories.select("id", spaced_words(F.col(text_col)).alias("words"), *keep)
    length = F.when(F.col("words") == "", 0.0).otherwise(occurrences(F.col("words"), "  ") + 1.0)
    counts = (occurrences(F.col("words"), f" {t} ").alias(f"tf{k}") for k, t in enumerate(terms))
    return materialize(words.select("id", length.alias("length"), *counts, *words.columns[2:]), "terms")


def keyword_scores(counted: DataFrame, n_terms: int) -> DataFrame:
    """id and score of the rows of ``count_terms`` with any term; an aggregate gives the corpus figures, no posting is shuffled."""
    tf = [F.col(f"tf{k}") for k in range(n_terms)]
    found = (F.sum(F.when(t > 0, 1.0).otherwise(0.0)).alias(f"df{k}") for k, t in enumerate(tf))
    figures = counted.agg(F.count("*").cast("double").alias("docs"), F.avg("length").alias("average"), *found)
    hits = counted.where(sum(tf, F.lit(0.0)) > 0).join(F.broadcast(figures))  # figures is one row
    parts = [ranking.bm25_term(t, F.col("length"), F.col("average"), F.col("docs"), F.col(f"df{k}")) for k, t in enumerate(tf)]
    return hits.select("id", sum(parts, F.lit(0.0)).alias("score"))


def bm25(memories: DataFrame, query: str, text_col: str = "source_text") -> DataFrame:
    """id and keyword score of the rows that hold any term of the query."""
    terms = query_terms(query)
    return keyword_scores(count_terms(memories, terms, text_col), len(terms))


def min_max(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds the positive scores' place between the smallest and largest; 0 for all where these are equal."""
    ends = scores.where(F.col(score) > 0).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    scaled = (F.col(score) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    return scores.join(F.broadcast(ends)).withColumn("scaled", F.when((F.col(score) > 0) & (F.col("__high") > F.col("__low")), scaled).otherwise(0.0)).drop("__low", "__high")


def entity_terms(query: str) -> list[str]:
    """Words of a query that may name an entity."""
    return [w for w in (re.sub("[^A-Za-z0-9]", "", x) for x in query.split()) if len(w) > 2]


def named_ids(entities: DataFrame, query: str) -> DataFrame:
    """Distinct memory ids with an entity that holds a word of the query."""
    return entities.where(any_ilike(F.col("entity"), entity_terms(query))).select(F.col("memory_id").alias("id")).distinct()


def hybrid(memories: DataFrame, entities: DataFrame, query: str, embedding: Sequence[float], now: datetime, limit: int = 25, offset: int = 0, min_similarity: float | None = 0.3, keep_keyword_only: bool = False) -> DataFrame:
    """Fused search over rows that already passed the filters.

    A page by similarity and recency and the best 3 * limit keyword rows meet in a full outer join on
    the id; the fused score orders them; the similarity cut comes after the limit, so rows found by
    keywords alone take places and then go, unless ``keep_keyword_only``. The memories are read once: what
    both ways and the fusion need is a few numbers a row, which are written.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    terms = query_terms(query)
    similarity, has = vector.cosine_to(F.col("embedding"), embedding), F.col("embedding").isNotNull()
    counted = count_terms(memories, terms, "source_text", "type", "created_at", F.when(has, similarity).alias("similarity"), has.alias("has"))
    able = counted.where("has")
    scored = able.select("id", "type", "created_at", "similarity").withColumn("page", F.round(ranking.page_score(F.col("similarity"), ranking.recency_calendar(F.col("created_at"), moment, F.col("type"))), 6))
    page = top(scored, F.desc("page"), F.asc("id"), limit=limit, offset=offset).drop("page")
    keyword_rows = keyword_scores(counted, len(terms)).withColumn("score", F.round("score", 4))
    found = min_max(top(keyword_rows.where("score > 0"), F.desc("score"), F.asc("id"), limit=3 * limit))
    extra = able.select("id", F.col("type").alias("type_"), F.col("created_at").alias("created_")).join(F.broadcast(found.select("id", "scaled")), "id")  # 3 * limit rows
    both = page.join(extra, "id", "full_outer").join(named_ids(entities, query).withColumn("named", F.lit(True)), "id", "left")
    kind, created = F.coalesce("type", "type_"), F.coalesce("created_at", "created_")
    fused = ranking.fused_score(F.coalesce("similarity", F.lit(0.0)), F.coalesce("scaled", F.lit(0.0)), ranking.recency_elapsed(created, moment, kind), F.coalesce("named", F.lit(False)))
    rows = both.select("id", kind.alias("type"), created.alias("created_at"), F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"), F.round(fused, 6).alias("score"))
    best = top(rows, F.desc("score"), F.asc("id"), limit=limit)
    if min_similarity is None or keep_keyword_only:
        return best
    return best.where(F.col("similarity") >= min_similarity)


def approximate_nearest(memories: DataFrame, query: Sequence[float], limit: int = 25, probes: int | None = None) -> DataFrame:
    """An index of centroid lists, and the exact order within the lists nearest to the query.

    For repeated searches build the index once (``vector_index.build``) and ask that; ``nearest`` is exact and needs one pass.
    """
    index = vector_index.build(memories)
    return vector_index.nearest(index, memories.sparkSession, query, limit, probes).select(*memories.columns, "similarity")
