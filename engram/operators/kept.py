"""Tables that grow by parts: each change writes new files only, and one commit names all parts that count.

A part is a folder ``v=<number>-<random>`` with a folder ``t=<name>`` for each of its tables. Names sort by the order of the commits.
A write that fails leaves a part that no commit names; of two writers from one state the later fails (``mutate.commit``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from engram.operators import mutate


def state(spark: SparkSession, folder: str) -> tuple[int, list[list]]:
    """Number of the last commit, and its parts as [name, tables]; (0, []) where nothing was committed."""
    commits = mutate.table_commits(spark, folder)
    return (commits[-1][0], json.loads(commits[-1][1])) if commits else (0, [])


def read(spark: SparkSession, folder: str, table: str, schema: StructType, parts: list[list] | None = None) -> DataFrame:
    """A table over the parts that have it, with the part's name as column v."""
    folder = folder.rstrip("/")
    own = StructType([*schema.fields]).add("v", StringType())
    paths = [f"{folder}/v={name}/t={table}" for name, tables in (state(spark, folder)[1] if parts is None else parts) if table in tables]
    if not paths:
        return spark.createDataFrame([], own)
    return spark.read.schema(own).option("basePath", folder).parquet(*paths).select(*own.names)


def add(spark: SparkSession, folder: str, seen: tuple[int, list[list]], make: Callable[[Callable[[str, DataFrame], DataFrame]], None], alone: bool = False) -> str:
    """Write a part and commit it beside the parts of the state ``seen``, or ``alone`` in their place; the part's name.

    ``make`` gets a function that writes a frame as a table of the part and reads it back.
    """
    folder, (number, parts) = folder.rstrip("/"), seen
    name = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
    tables: list[str] = []

    def write(table: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/v={name}/t={table}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        tables.append(table)
        return spark.read.schema(df.schema).parquet(path)

    make(write)
    mutate.commit(spark, folder, json.dumps([*([] if alone else parts), [name, tables]]), number)
    return name


def tidy(spark: SparkSession, folder: str, keep: int = 2, seconds: float = 86_400, now: datetime | None = None) -> list[str]:
    """Remove parts that none of the last ``keep`` commits names and that are older than ``seconds``; their names."""
    return mutate.tidy_table(spark, folder, keep, seconds, now, lambda said: [name for name, _ in json.loads(said)])
