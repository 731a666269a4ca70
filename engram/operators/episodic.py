"""Captures: hourly de-duplication, raw listing and the latest one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.filters import fresh, metadata_is, metadata_missing, preferred_first, top


def hour_of(created: Column) -> Column:
    return F.date_trunc("hour", created).cast("timestamp_ntz")


def dedup_hourly(captures: DataFrame, keys: Sequence[str], scores: DataFrame | None = None, whole_rows: bool = False) -> DataFrame:
    """One row for each type, metadata keys (null keys together) and hour.

    Every other column is the smallest of its group taken by itself, so a row may mix several; with
    ``whole_rows`` the columns are those of the smallest id. ``scores`` (id, score) adds the largest
    score of the group, 0 for ids without one.
    """
    held = captures if scores is None else captures.join(scores.select("id", "score"), "id", "left")
    groups = {f"key_{k}": F.get_json_object("metadata", f"$.{k}") for k in keys}
    held = held.withColumns({**groups, "hour": hour_of(F.col("created_at"))})
    others = [c for c in captures.columns if c not in ("type", "id")]
    pick = (lambda c: F.min_by(c, "id")) if whole_rows else F.min
    aggs = [F.min("id").alias("id"), *(pick(c).alias(c) for c in others), F.count("*").alias("captures")]
    if scores is not None:
        aggs.append(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    return held.groupBy("type", *groups, "hour").agg(*aggs)


def search(captures: DataFrame, keys: Sequence[str], scores: DataFrame | None = None, dedup: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """By score (where keywords were given), then newest first."""
    if dedup:
        rows = dedup_hourly(captures, keys, scores)
    elif scores is None:
        rows = captures
    else:
        rows = captures.join(scores.select("id", "score"), "id", "left").fillna(0.0, ["score"])
    order = [F.desc("created_at"), F.asc("id")]
    return top(rows, *([F.desc("score")] if scores is not None else []), *order, limit=limit, offset=offset)


def recent(captures: DataFrame, now: datetime, app: str | None = None, seconds: float = 3, app_key: str = "appName", taint_key: str = "overlayTainted") -> DataFrame:
    """The newest untainted capture within a few seconds, one of the preferred app before all others."""
    held = captures.where(fresh(F.col("created_at"), now, seconds) & metadata_missing(F.col("metadata"), taint_key))
    wanted = metadata_is(F.col("metadata"), app_key, app) if app is not None else F.lit(False)
    return preferred_first(held, F.coalesce(wanted, F.lit(False)), F.desc("created_at"), F.asc("id"))
