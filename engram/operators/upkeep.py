"""Retention, migration of flags, health and request statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import overlay_tainted
from engram.storage import materialize

MOST_DAYS, PURGE_DAYS = 1825, 365


def span(df: DataFrame, created: str = "created_at") -> DataFrame:
    """One row: oldest, newest, total and the days between."""
    return df.agg(F.min(created).alias("oldest"), F.max(created).alias("newest"), F.count("*").alias("total")).withColumn("days", F.floor((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("oldest").cast("timestamp"))) / F.lit(86_400_000_000)))


def cutoff(df: DataFrame, most_days: int = MOST_DAYS, purge_days: int = PURGE_DAYS) -> datetime | None:
    """Before when rows go; None while the table spans no more than ``most_days``. One row comes to the driver."""
    got = span(df).first()
    if got.days is None or got.days <= most_days:
        return None
    return df.sparkSession.range(1).select(F.expr(f"TIMESTAMP_NTZ '{got.oldest}' + INTERVAL '{int(purge_days)}' DAY")).first()[0]


def purge(memories: DataFrame, entities: DataFrame, before: datetime) -> tuple[DataFrame, DataFrame]:
    """Both tables without rows created before a moment; entities go with their rows."""
    at = F.lit(before).cast("timestamp_ntz")
    gone = memories.where(F.col("created_at") < at).select(F.col("id").alias("memory_id"))
    return memories.where(F.coalesce(F.col("created_at") >= at, F.lit(True))), entities.join(gone, "memory_id", "left_anti")


def retain(memories: DataFrame, entities: DataFrame, most_days: int = MOST_DAYS, purge_days: int = PURGE_DAYS) -> tuple[DataFrame, DataFrame]:
    before = cutoff(memories, most_days, purge_days)
    return (memories, entities) if before is None else purge(memories, entities, before)


def flag_tainted(captures: DataFrame, products: tuple[str, ...] = (), text: str = "source_text", key: str = "overlayTainted") -> DataFrame:
    """Sets a flag in the metadata of captures whose text an overlay shows through, unless it is set."""
    bare = F.coalesce(F.col("metadata"), F.lit("{}"))
    flagged = F.when(F.regexp_like(bare, F.lit(r"^\{\s*\}$")), F.lit(f'{{"{key}":true}}')).otherwise(F.regexp_replace(bare, r"\}\s*$", f',"{key}":true}}'))
    needs = overlay_tainted(F.col(text), products) & F.get_json_object("metadata", f"$.{key}").isNull()
    return captures.withColumn("metadata", F.when(needs, flagged).otherwise(F.col("metadata")))


def embedding_health(memories: DataFrame, now: datetime) -> DataFrame:
    """One row: total, with and without vector, coverage in per cent, rows of the last hour."""
    has = F.col("embedding").isNotNull()
    recent = F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '1' HOUR")
    counted = memories.agg(F.count("*").alias("total"), F.count_if(has).alias("with_embedding"), F.count_if(~has).alias("without_embedding"), F.count_if(recent).alias("last_hour"))
    return counted.withColumn("coverage", F.when(F.col("total") > 0, F.round(100.0 * F.col("with_embedding") / F.col("total"), 1)).otherwise(0.0))


def nearest_rank(df: DataFrame, column: str, *shares: float, by: str | None = None, pieces: int = 4096) -> DataFrame:
    """Percentiles as values that occur: the one at place ceil(share * n) of the values that are not null.

    Values are counted; a group's range is cut into ``pieces`` parts whose sums tell which part holds a
    place, and only the counts within those parts are ordered, so no task holds all values of a group.
    """
    keys = [by] if by else []
    names = {s: f"p{s * 100:g}".replace(".", "_") for s in shares}
    counted = materialize(df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n")), "counted")
    edge = counted.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    on = keys or ["k"]
    if not keys:
        edge, counted = edge.withColumn("k", F.lit(1)), counted.withColumn("k", F.lit(1))
    held = counted.join(edge, on)
    part = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double") * (pieces - 1))).otherwise(0)
    held = held.withColumn("part", part)
    sums = held.groupBy(*on, "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("total"))).alias("place")) for s in shares))).alias("a")
    places = edge.select(*on, asked).select(*on, "a.share", "a.place")
    wanted = sums.withColumn("before", before).join(places, on).where((F.col("before") < F.col("place")) & (F.col("place") <= F.col("before") + F.col("m")))
    inside = held.select(*on, "part", "v", "n").join(wanted.select(*on, "part", "share", "place", "before"), [*on, "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*on, "part", "share").orderBy("v"))
    hit = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
    return hit.groupBy(*on).agg(*(F.max(F.when(F.col("share") == s, F.col("v"))).alias(names[s]) for s in shares)).select(*keys, *names.values())


def request_statistics(log: DataFrame, action: str = "action", failed: Column | None = None, millis: str = "millis") -> DataFrame:
    """Requests, errors, and mean time of each action."""
    bad = F.col("failed") if failed is None else failed
    return log.groupBy(action).agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.avg(millis).alias("mean_millis"), F.sum(millis).alias("total_millis"))


def hit_rate(log: DataFrame, hit: Column) -> DataFrame:
    return log.agg(F.count_if(hit).alias("hits"), F.count("*").alias("lookups")).withColumn("rate", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(0.0))


def due(runs: DataFrame, now: datetime, key: str, at: str, hours: int = 24) -> DataFrame:
    """key, last_run and due: whether a periodic job's last run lies at least ``hours`` back."""
    last = runs.groupBy(key).agg(F.max(at).alias("last_run"))
    return last.withColumn("due", F.lit(now).cast("timestamp_ntz") >= F.col("last_run") + F.expr(f"INTERVAL '{int(hours)}' HOUR"))


def maintain(memories: DataFrame, entities: DataFrame, last_run: datetime | None, now: datetime, stopping: bool = False, hours: int = 24, most_days: int = MOST_DAYS, purge_days: int = PURGE_DAYS) -> tuple[DataFrame, DataFrame, datetime | None]:
    """One turn of the periodic job: retention where it is due or the service stops; both tables and the moment of the last run."""
    if not stopping and last_run is not None and (now - last_run).total_seconds() < hours * 3600:
        return memories, entities, last_run
    return *retain(memories, entities, most_days, purge_days), now


def purge_older(memories: DataFrame, entities: DataFrame, now: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """The purge by hand: rows older than so many days go."""
    return purge(memories, entities, now - timedelta(days=days))
