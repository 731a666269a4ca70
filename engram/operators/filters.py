"""Filters, sorts and pages."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.storage import materialize

#: Columns that a caller may sort by.
SORTABLE = ("created_at", "updated_at", "type", "id", "hit_count", "priority")
CAPTURES = "screen_capture"


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def time_range(created: Column, now: datetime, start: datetime | None = None, end: datetime | None = None, max_age_days: int | None = 365) -> Column:
    """A start wins over an age; ages of 0 and below do not count; the end is inclusive."""
    low = None
    if start is not None:
        low = created >= F.lit(start).cast("timestamp_ntz")
    elif max_age_days is not None and max_age_days > 0:
        low = created >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(max_age_days)}' DAY")
    return all_of(low, None if end is None else created <= F.lit(end).cast("timestamp_ntz"))


def types_in(kind: Column, wanted: str | Sequence[str] | None = None, unwanted: str | Sequence[str] | None = None) -> Column:
    """Types to keep and to drop (a null type is dropped by either); captures only where asked for by name."""
    listed = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
    keep, drop = listed(wanted), listed(unwanted)
    if CAPTURES not in keep:
        drop = [*drop, CAPTURES]
    return all_of(kind.isin(keep) if keep else None, ~kind.isin(drop) if drop else None)


def metadata_is(metadata: Column, key: str, value: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}") == value


def metadata_missing(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}").isNull()


def metadata_not_in(metadata: Column, key: str, values: Sequence[str]) -> Column:
    """The key is there and none of these."""
    found = F.get_json_object(metadata, f"$.{key}")
    return found.isNotNull() & ~found.isin(list(values))


def session_like(metadata: Column, session: str) -> Column:
    """Textual match of a session in compact JSON; % and _ in the session are wildcards."""
    return metadata.like(f'%"sessionId":"{session}"%')


def any_ilike(column: Column, terms: Sequence[str]) -> Column:
    """Contains any of the terms, in either case."""
    return reduce(operator.or_, [column.ilike(f"%{t}%") for t in terms], F.lit(False))


def fresh(created: Column, now: datetime, seconds: float = 3) -> Column:
    return created >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{seconds}' SECOND")


def active(status: Column) -> Column:
    return F.coalesce(status, F.lit("active")) == "active"


#: A page that ends further down than this is found by the counts of range partitions.
DEEP = 100_000


def top(df: DataFrame, *order: Column, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page in order; Spark keeps limit + offset rows a task, and of deep pages only the parts that the page lies in."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset + limit <= DEEP else deep_page(df, *order, limit=limit, offset=offset)


def _in_ranges(df: DataFrame, order: Sequence[Column], part: str) -> DataFrame:
    """The rows dealt to ranges of the order, written once with the number of their range. Rows that tie in the whole order lie in one range."""
    return materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")


def deep_page(df: DataFrame, *order: Column, limit: int, offset: int) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in order, however deep.

    The counts of the ranges of the order (a row each) tell which of them the page touches, and only those are read and sorted.
    """
    part = "__part"
    ranged = _in_ranges(df, order, part)
    start, before, touched = 0, 0, []
    for r in sorted(ranged.groupBy(part).count().collect()):  # a row for each range
        if start < offset + limit and start + r["count"] > offset:
            before = before if touched else start
            touched.append(r[part])
        start += r["count"]
    rows = ranged.where(F.col(part).isin(touched)) if touched else ranged.limit(0)
    return rows.drop(part).orderBy(*order).offset(offset - before if touched else 0).limit(limit)


def placed(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the place of each row in the order of all rows, from 1; no task holds more than a range of the order.

    A range is numbered by itself, and starts where the counts of the ranges before it (a row each) end.
    """
    part = "__part"
    ranged = _in_ranges(df, order, part)
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(part).count().select(part, F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(starts), part).withColumn(name, F.col("__start") + place).drop(part, "__start")


def sorted_page(df: DataFrame, by: str = "created_at", descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page by a column that may be sorted by; ties go by id."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by!r}; one of {', '.join(SORTABLE)}")
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return top(df, order, F.asc("id"), limit=limit, offset=offset)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, and whether rows follow the page."""
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def best_per(df: DataFrame, key: str, *order: Column, limit: int = 1) -> DataFrame:
    """The first rows of each key; tasks keep ``limit`` rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def preferred_first(df: DataFrame, is_preferred: Column, *order: Column, limit: int = 1) -> DataFrame:
    return top(df, F.when(is_preferred, 0).otherwise(1), *order, limit=limit)
