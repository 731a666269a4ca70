"""Mixing sources to target weights: every source is cut at its budget of words, in a random order that never changes.

Each document gets a hash-random key. Documents are range-sorted by source and key, word counts are summed up along that
order (within the parts, then over the parts), and a source's documents are taken up to its exact budget: whole epochs
first, then the beginning of the order, the document at the cut only with its first words.

Defined results: a null or blank text has size 0 and takes nothing; a null source is a source of its own, the last; a
null id is an id like any other; equal rows each get their own result and may be cut apart; sources without words have
target 0; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from engram.storage import materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many epochs.
MOST_EPOCHS = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def sums_before(rows: DataFrame, group: str, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """``rows`` with ``before_<name>`` for each name in ``sums``: its total over the rows of the group that stand earlier.

    group and sums are long columns without nulls. Rows are range-partitioned and sorted by group and order, so one group
    may span any number of tasks; each task adds up its own part of a group, and the totals of the parts (a row for each
    part and group) give what stands before each. Rows that tie in the order come one after the other.
    """
    fields = [*rows.schema.fields, *(StructField(f"before_{x}", LongType()) for x in sums), StructField("part", IntegerType())]
    at = [rows.columns.index(x) for x in (group, *sums)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at[0]).to_numpy()
            first = np.r_[0, np.flatnonzero(np.diff(groups)) + 1]
            sizes = np.diff(np.r_[first, len(groups)])
            out = []
            for k, place in enumerate(at[1:]):
                value = batch.column(place).to_numpy()
                before = np.cumsum(value) - value
                base = before[first]
                base[0] -= carried[k] if groups[0] == last else 0
                before = before - np.repeat(base, sizes)
                carried[k] = int(before[-1] + value[-1])
                out.append(pa.array(before, pa.int64()))
            last = groups[-1]
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:-1], *out, columns[-1]], names=[f.name for f in fields])

    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())
    within = materialize(ranged.mapInArrow(add_up, StructType(fields)), "ranged")
    parts = within.groupBy(group, "part").agg(*(F.sum(x).alias(f"all_{x}") for x in sums))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = parts.select(group, "part", *(F.coalesce(F.sum(f"all_{x}").over(earlier), F.lit(0)).alias(f"all_{x}") for x in sums))
    joined = within.join(offsets, [group, "part"])
    return joined.select(*rows.columns, *((F.col(f"before_{x}") + F.col(f"all_{x}")).alias(f"before_{x}") for x in sums))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size (long), source_no (its place, from 0, nulls last) and target (double) from distinct sources and sizes.

    Sources share the total by weight. Those above ``most_epochs`` times their own size stop there and the excess is shared
    again: sorted by the share at which they stop, the sources that stop are the first, so sums along that order tell what
    is left for the others. Only these two numbers come to the driver.
    """
    rows = sources.select("source", "source_size", F.lit(0).cast("long").alias("all"), F.lit(1).cast("long").alias("one"))
    ranked = sums_before(rows, "all", [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.lit(list(weights)).cast("array<long>"), (F.col("before_one") % len(weights) + 1).cast("int"))
    rows = materialize(ranked.select("source", "source_size", F.col("before_one").alias("source_no"), weight.alias("weight"), "all"), "sources")
    most = F.lit(most_epochs) * F.col("source_size")
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"]:
        return rows.select("source", "source_size", "source_no", F.lit(0.0).alias("target"))
    along = sums_before(rows, "all", [most / F.col("weight"), F.col("source_no")], ["source_size", "weight"])
    left = (F.lit(total["size"]) - most_epochs * F.col("before_source_size")).alias("left")
    among = (F.lit(total["weight"]) - F.col("before_weight")).alias("among")
    wide = "decimal(38,0)"
    fits = left.cast(wide) * F.col("weight") <= most.cast(wide) * among.cast(wide)
    rest = along.select("before_weight", left, among, fits.alias("fits")).where("fits").agg(F.min_by(F.struct("left", "among"), "before_weight").alias("r")).first().r
    share = F.lit(float(rest.left)) * F.col("weight") / F.lit(float(rest.among))
    return rows.select("source", "source_size", "source_no", F.least(most.cast("double"), share).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """id, size, source_size, target (the source's), taken (words the mix takes), source and full_epochs of each document.

    The words taken of a source are its target, rounded. The order depends on id, text and seed alone.
    """
    if most_epochs < 1 or not weights or min(weights) < 1:
        raise ValueError("weights and epochs must be whole numbers of at least one")
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.left(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))), F.lit(16)).alias("key"),
        F.monotonically_increasing_id().alias("tie"),  # tells only wholly equal rows apart
    )
    sized = materialize(sized, "sized")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs), "targets")
    t = targets.withColumnRenamed("source", "its_source")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    rows = sums_before(rows, "source_no", [F.col("key"), F.col("id"), F.col("size"), F.col("tie")], ["size"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_size")))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), F.col("source").alias(source_col), epochs.alias("full_epochs")
    )


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      left(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)), 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
a AS (SELECT *, (SELECT sum(source_size) FROM w) - 3 * coalesce(sum(source_size) OVER o, 0) AS left_,
      (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS among
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT max_by(left_, among) AS left_, max(among) AS among FROM a WHERE left_ * weight <= 3 * source_size * among),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), CAST(left_ AS DOUBLE) * weight / CAST(among AS DOUBLE)) AS target FROM w, r),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS full_epochs FROM t),
p AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.budget, b.full_epochs,
      CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - before)) AS BIGINT) AS taken, source, CAST(full_epochs AS BIGINT) AS full_epochs
FROM p
"""
