"""The data model seen in the star-schema tables, in Spark and as SQL for the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed moments that stand for now.
DOC_NOW, EVENT_NOW = datetime(2025, 3, 1), datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """The scan ``df`` dealt to all cores where its files give fewer splits than that; else as it is.

    For work that costs far more than moving the rows; tables of any size have splits enough.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories without vectors."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("user_id"),
        F.col("lang").alias("type"),
        F.col("text").alias("source_text"),
        F.concat(F.lit('{"sessionId":"s'), F.col("doc_id") % 50, F.lit('","appName":"'), F.col("source"), F.lit('"}')).alias("metadata"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(int(doc_id % 400), int(doc_id % 24), int(doc_id % 60))").alias("created_at"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return wide(notes(spark, sf_dir)).join(e, "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as entities of memories."""
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id AS memory_id", "stack(2, 'quality', quality, 'toxic', toxic) AS (type, value)")
    return rows.select("memory_id", "type", F.concat_ws("_", "type", F.col("value").cast("string")).alias("entity"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures; the key k of their properties stands for the app."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("type"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"), "value")


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw rows of the capture stream: app by type, title by k, text by both."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("ts"), F.col("event_id").alias("capture_id"), F.col("user_id"),
        F.when(k % 7 == 0, F.concat(F.lit("Electron "), "event_type")).otherwise(F.col("event_type")).alias("app"),
        F.concat(F.lit("title "), k % 3).alias("title"),
        F.when(k % 11 == 0, 600_000).otherwise(1000).cast("long").alias("idle_ms"),
        F.round((k % 10) / 20.0, 2).alias("diff_ratio"),
        (F.lit(1000) + k * 10).alias("width"), F.lit(800).alias("height"),
        F.concat(F.lit("line of "), "event_type", F.lit("\nscreen number "), k % 4, F.when(k % 13 == 0, F.lit("")).otherwise(F.lit("\ncommon last line"))).alias("ocr_raw"),
    )


#: The same in SQL, to be put after WITH.
SQL = {
    "notes": """notes AS (SELECT doc_id AS id, source AS user_id, lang AS type, text AS source_text,
      '{"sessionId":"s' || (doc_id % 50) || '","appName":"' || source || '"}' AS metadata,
      TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 400 AS INTEGER)) + to_hours(doc_id % 24) + to_minutes(doc_id % 60) AS created_at FROM documents)""",
    "memory": "memory AS (SELECT n.*, e.embedding::DOUBLE[] AS embedding FROM notes n JOIN embeddings e ON n.id = e.vec_id)",
    "entities": """entities AS (SELECT doc_id AS memory_id, 'quality' AS type, 'quality_' || quality AS entity FROM labels
      UNION ALL SELECT doc_id, 'toxic', 'toxic_' || toxic FROM labels)""",
    "captures": "captures AS (SELECT event_id AS id, user_id, event_type AS type, props AS metadata, ts AS created_at, value, json_extract_string(props, '$.k') AS k FROM events)",
    "screen": """screen AS (SELECT ts, event_id AS capture_id, user_id, CASE WHEN k % 7 = 0 THEN 'Electron ' || event_type ELSE event_type END AS app,
      'title ' || (k % 3) AS title, CASE WHEN k % 11 = 0 THEN 600000 ELSE 1000 END AS idle_ms, round((k % 10) / 20.0, 2) AS diff_ratio, 1000 + k * 10 AS width, 800 AS height,
      'line of ' || event_type || chr(10) || 'screen number ' || (k % 4) || CASE WHEN k % 13 = 0 THEN '' ELSE chr(10) || 'common last line' END AS ocr_raw
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "q": "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)",
}


def with_views(*names: str, rest: str) -> str:
    """SQL over some of the views."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + rest
