"""Exact histogram of encoded lengths, and what its suffix sums answer.

Defined results: a null or empty text has length 0 and is counted; equal rows count each; an empty
table gives an empty histogram (all answers are then 0 or None); other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.arrow import map_arrow
from engram.llm.encoding import SEGMENT, Encoder
from engram.storage import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Lengths summed together in the upper level of the suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """id and n_tokens of each whole text."""

    def lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, before = Encoder.of(tokenizer).encode(batch.column(1), ids=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(before), pa.int64())], names=[id_col, "n_tokens"])

    wanted = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_arrow(wanted, lengths, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long", SEGMENT)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens (each length that occurs), n_docs; Spark adds up within tasks before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: what a corpus cut at that limit holds.

    docs_over and tokens_over are suffix sums over longer lengths; truncated_tokens is the total of
    min(length, limit); docs_within gives every quantile. The sums are taken in two levels, so that
    no task holds more lengths than BLOCK and one number for each block.
    """
    tokens = F.col("n_docs") * F.col("n_tokens")
    h = materialize(histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "histogram")

    def before(column: str, order) -> F.Column:
        return F.coalesce(F.sum(column).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    blocks = blocks.select("block", before("d", F.desc("block")).alias("d"), before("t", F.desc("block")).alias("t"), before("d", F.asc("block")).alias("w"), before("t", F.asc("block")).alias("u"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d")).alias("docs_over"),
        (F.coalesce(F.sum(tokens).over(longer), F.lit(0)) + F.col("t")).alias("tokens_over"),
        (F.sum("n_docs").over(within) + F.col("w")).alias("docs_within"),
        (F.sum(tokens).over(within) + F.col("u")).alias("tokens_within"),
    )
    return out.withColumn("truncated_tokens", F.col("tokens_within") + F.col("docs_over") * F.col("n_tokens"))


def answers(histogram: DataFrame, limit: int, quantile: float = 0.5) -> dict[str, int | None]:
    """Totals, the smallest length with at least that share of documents, and the total when cut at any limit."""
    n = F.col("n_docs")
    total = histogram.agg(F.sum(n).alias("d"), F.sum(n * F.col("n_tokens")).alias("t"), F.sum(n * F.least("n_tokens", F.lit(limit))).alias("c")).first()
    if not total.d:
        return {"docs": 0, "tokens": 0, "truncated_tokens": 0, "quantile": None}
    at = context_limits(histogram).where(F.col("docs_within") >= quantile * total.d).agg(F.min("n_tokens")).first()[0]
    return {"docs": total.d, "tokens": total.t, "truncated_tokens": total.c, "quantile": at}
