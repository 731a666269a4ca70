"""Joins that add child rows, statuses and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the entities of each row as a sorted array, empty where there are none; one join for all rows."""
    fields = [c for c in ("type", "entity", "entity_type") if c in entities.columns]
    own = entities.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entities"))
    shape = own.schema["entities"].dataType.simpleString()
    return rows.join(own, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(shape)))


def unhealthy(health: DataFrame, skills: DataFrame, everything: bool = False) -> DataFrame:
    """Skill health with what is known of each skill; a skill that is not installed counts as disabled."""
    held = health if everything else health.where("status <> 'ok'")
    joined = held.join(skills.withColumnRenamed("name", "skill_name"), "skill_name", "left")
    return joined.withColumn("enabled", F.coalesce("enabled", F.lit(False))).orderBy(F.desc_nulls_last("last_checked_at"), "skill_name")


def rows_of(children: DataFrame, parents: DataFrame, key: str = "memory_id") -> DataFrame:
    """Children of the given parents."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def rows_not_of(children: DataFrame, parents: DataFrame, key: str = "memory_id") -> DataFrame:
    """Children of no given parent."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_anti")


def move_missing(source: DataFrame, target: DataFrame, moves) -> tuple[DataFrame, DataFrame]:
    """Rows of source that ``moves`` go to target unless their id is there; returns both new versions."""
    going = source.where(moves)
    new_target = target.unionByName(going.join(target.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return source.where(~F.coalesce(moves, F.lit(False))), new_target


def rules_by_key(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Active rules of each key, best first; of all keys where none are given."""
    held = rules.where(F.coalesce("status", F.lit("active")) == "active")
    if keys is not None:
        held = held.where(F.lower(F.col("context_key")).isin([k.lower() for k in keys]))
    order = F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), (-F.coalesce("verified_count", F.lit(0))).alias("v"), (-F.coalesce("hit_count", F.lit(0))).alias("h"), F.col("id"), F.col("rule_text"))
    return held.groupBy("context_key").agg(F.transform(F.sort_array(F.collect_list(order)), lambda r: r["rule_text"]).alias("rules"))
