"""Skills, traits, speakers and tasks kept by key; lists with optional filters; what tables there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import mutate
from engram.operators.filters import all_of


def install_skills(base: DataFrame, changes: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """The skills after an install, by name, and the changes refused for their contract's ``error``; a reinstall keeps whether a skill is enabled."""
    good = changes.where(F.col("error").isNull()).drop("error")
    held = good.join(base.select(key, F.col("enabled").alias("__was")), key, "left").withColumn("enabled", F.coalesce("__was", F.lit(True))).drop("__was")
    return mutate.latest_wins(base, held.select(*base.columns), key), changes.where(F.col("error").isNotNull())


def upsert_health(base: DataFrame, checks: DataFrame, key: str = "skill_name", stamp: str = "last_checked_at") -> DataFrame:
    """The newest check of each skill in place of what was known of it."""
    return mutate.latest_wins(base, checks, key, stamp, tie="status")


def upsert_traits(base: DataFrame, changes: DataFrame, key: str = "trait_key", fields: Sequence[str] = ("trait_value", "weight")) -> DataFrame:
    """A known trait gets the fields that a change gives, and keeps its others; an unknown one is added. The newest change of a key counts."""
    newest = mutate.latest_wins(changes.limit(0), changes, key)
    known = newest.join(base.select(key), key, "left_semi")
    added = newest.join(base.select(key), key, "left_anti")
    return mutate.patch(base, known, key, [*fields, "updated_at"]).unionByName(added.select(*base.columns))


def rename(base: DataFrame, names: DataFrame, key: str, column: str = "name") -> DataFrame:
    """New names (key, new_name) where they are not blank; trimmed."""
    given = names.select(key, F.trim("new_name").alias(column)).where(F.col(column) != "")
    return mutate.patch(base, given, key, [column])


def listing(df: DataFrame, filters: Mapping[str, object | None], *order: Column, at_least: Mapping[str, float | None] | None = None) -> DataFrame:
    """The rows that agree with every filter that is given (a list: any of its values), in order."""
    conditions = [None if v is None else F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in filters.items()]
    conditions += [None if v is None else F.col(k) >= F.lit(v) for k, v in (at_least or {}).items()]
    kept = df.where(all_of(*conditions))
    return kept.orderBy(*order) if order else kept


def given_or(column: Column, default: Column | str | float, kind: str = "string") -> Column:
    """A value, or the default where it is missing, blank or zero."""
    missing = column.isNull() | ((column == "") if kind == "string" else (column == 0))
    return F.when(missing, default if isinstance(default, Column) else F.lit(default)).otherwise(column)


def with_manifests(skills: DataFrame, manifests: DataFrame, key: str = "name") -> DataFrame:
    """Adds goal_tied: whether a skill's manifest (name, manifest: the file's text) says so with a true; a missing or broken file says no."""
    value = F.try_variant_get(F.try_parse_json("manifest"), "$.goal_tied", "variant")
    said = manifests.select(key, F.coalesce(F.schema_of_variant(value) == "BOOLEAN", F.lit(False)).alias("__told"), F.to_json(value).alias("__value"))
    return skills.join(said, key, "left").withColumn("goal_tied", F.coalesce(F.col("__told") & (F.col("__value") == "true"), F.lit(False))).drop("__told", "__value")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """name and manifest of the files in folders name=<skill> below a folder; a file is one row."""
    return spark.read.schema("value string, name string").text(folder, wholetext=True).select("name", F.col("value").alias("manifest"))


def catalogue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name and ordinal_position (from 1) of all columns; schemas only, no rows are read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, i) for t, df in tables.items() for i, c in enumerate(df.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position long")


def missing_columns(tables: Mapping[str, DataFrame], wanted: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(table, column) pairs that are wanted and not there; a missing table misses all of its columns."""
    return [(t, c) for t, columns in wanted.items() for c in columns if t not in tables or c not in tables[t].columns]


def best_match(memories: DataFrame, similarity: Column, least: float, key: str = "user_id", id_col: str = "id") -> DataFrame:
    """Why a search finds nothing, for each user: rows, rows with a vector, the closest row, its similarity, and whether it is below the cut."""
    scored = memories.withColumn("__s", F.when(F.col("embedding").isNotNull(), similarity))
    best = F.max(F.when(F.col("__s").isNotNull(), F.struct(F.col("__s").alias("s"), (-F.col(id_col)).alias("i"))))
    out = scored.groupBy(key).agg(F.count("*").alias("total"), F.count("embedding").alias("with_embedding"), best.alias("b"))
    return out.select(key, "total", "with_embedding", (-F.col("b.i")).alias("best_id"), F.col("b.s").alias("best_similarity"), (F.col("b.s") < least).alias("below"))


def hydrate(memories: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """The full rows of candidate ids, in the candidates' order (rank); ids that are gone are left out."""
    return memories.join(candidates.select(key, "rank"), key).orderBy("rank")
