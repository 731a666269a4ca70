"""Changes as new versions of a table: every function takes frames and returns the table after the change.

Nothing is changed in place; ``replace_table`` writes a version beside the old one and then commits it as
the next number in a list of commits, so a reader of the old version is never disturbed and one that begins
sees a whole version. ``tidy_table`` removes what no commit in use names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators import search
from engram.operators.filters import best_per
from engram.schema import memory_id, text_error, valid_entities, valid_metadata
from engram.storage import materialize

#: What a prompt may be meant as.
INTENTS = ("command_automate", "memory_retrieve", "web_search", "screen_intelligence", "memory_store", "general_query", "set_constraint", "app_control_start", "general_knowledge")
SKILL_SAME, INTENT_SAME, PHRASE_SAME = 0.92, 0.95, 0.88


def latest_wins(base: DataFrame, changes: DataFrame, key: str | Sequence[str], stamp: str = "updated_at", tie: str = "id") -> DataFrame:
    """Insert or replace by key; of several rows of a key the newest stays."""
    keys = [key] if isinstance(key, str) else list(key)
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc_nulls_last(stamp), F.desc(tie)))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def insert_new(base: DataFrame, changes: DataFrame, key: Sequence[Column], tie: str = "id") -> DataFrame:
    """Append the changes whose key is not in the table; of equal changes the one with the smallest id."""
    names = [f"__k{i}" for i in range(len(key))]
    held = changes.withColumns(dict(zip(names, key)))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(tie))
    fresh_ = held.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    known = base.withColumns(dict(zip(names, key))).select(*names).distinct()
    return base.unionByName(fresh_.join(known, names, "left_anti").drop(*names), allowMissingColumns=True)


def patch(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Set the listed fields where a change gives them a value; other fields cannot be changed."""
    given = changes.select(key, *(F.col(f).alias(f"__{f}") for f in fields if f in changes.columns))
    out = base.join(given, key, "left")
    for f in fields:
        if f in changes.columns:
            out = out.withColumn(f, F.coalesce(f"__{f}", f))
    return out.select(*base.columns)


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    return base.where(~F.coalesce(condition, F.lit(False)))


def set_where(base: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    return base.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def add_hits(base: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """hit_count plus the rows of an access log."""
    counts = log.groupBy(key).agg(F.count("*").alias("__hits"))
    return base.join(counts, key, "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("__hits", F.lit(0))).drop("__hits")


def closest(base: DataFrame, changes: DataFrame, threshold: float, embedding: str = "embedding") -> DataFrame:
    """change_id, id and similarity of the closest stored row of each change at or above a threshold.

    Found once, in blocks of changes, and written, as the callers join it more than once.
    """
    asked = changes.select(F.col("id").alias("query_id"), F.col(embedding).alias("query_embedding"))
    found = search.lookup_many(base.select("id", F.col(embedding).alias("embedding")), asked, threshold)
    return materialize(found.withColumnRenamed("query_id", "change_id"), "closest")


def upsert_prompts(base: DataFrame, changes: DataFrame, threshold: float = SKILL_SAME) -> DataFrame:
    """A prompt close to a stored one replaces its text, tags and vector in place; others are added."""
    match = closest(base, changes, threshold)
    given = changes.select(F.col("id").alias("change_id"), F.col("tags").alias("__tags"), F.col("prompt_text").alias("__text"), F.col("embedding").alias("__vector"), F.col("updated_at").alias("__at"))
    into = best_per(match.join(given, "change_id"), "id", F.desc("similarity"), F.desc("change_id")).drop("similarity")
    out = base.join(into.drop("change_id"), "id", "left")
    hit = F.col("__text").isNotNull()
    for name, new in (("tags", "__tags"), ("prompt_text", "__text"), ("embedding", "__vector"), ("updated_at", "__at")):
        out = out.withColumn(name, F.when(hit, F.col(new)).otherwise(F.col(name)))
    added = changes.join(match.select(F.col("change_id").alias("id")), "id", "left_anti")
    return out.select(*base.columns).unionByName(added.select(*base.columns))


def upsert_intents(base: DataFrame, changes: DataFrame, threshold: float = INTENT_SAME) -> DataFrame:
    """Examples of a known intent; skipped where the closest stored example says the same."""
    able = changes.where(F.col("correct_intent").isin(*INTENTS))
    match = closest(base, able, threshold).join(base.select("id", F.col("correct_intent").alias("__stored")), "id").select(F.col("change_id").alias("id"), "__stored")
    kept = able.join(match, "id", "left").where(F.col("__stored").isNull() | (F.col("__stored") != F.col("correct_intent")))
    return base.unionByName(kept.select(*base.columns))


def upsert_phrases(base: DataFrame, changes: DataFrame, threshold: float = PHRASE_SAME) -> DataFrame:
    """Phrases; a close one that agrees is skipped, unless the user corrects; a differing one replaces equal text."""
    match = closest(base, changes, threshold).join(base.select("id", F.col("delivery").alias("__d"), F.col("service").alias("__s")), "id").select(F.col("change_id").alias("id"), "__d", "__s", F.lit(True).alias("__close"))
    held = changes.join(match, "id", "left")
    differs = (F.col("source") == "user_correction") | ~F.col("delivery").eqNullSafe(F.col("__d")) | ~F.col("service").eqNullSafe(F.col("__s"))
    kept = held.where(F.col("__close").isNull() | differs)
    replaced = kept.where(F.col("__close")).select("example_phrase").distinct()
    return base.join(replaced, "example_phrase", "left_anti").select(*base.columns).unionByName(kept.select(*base.columns))


def upsert_context_rules(base: DataFrame, changes: DataFrame) -> DataFrame:
    kind = F.when(F.lower("context_type").isin("app", "agent"), F.lower("context_type")).otherwise("site")
    tidy = changes.withColumn("context_type", kind).withColumn("context_key", F.lower(F.trim("context_key"))).withColumn("rule_text", F.trim("rule_text"))
    return insert_new(base, tidy, [F.col("context_type"), F.col("context_key"), F.trim("rule_text")])


def upsert_api_rules(base: DataFrame, changes: DataFrame) -> DataFrame:
    tidy = changes.withColumn("service", F.lower("service")).withColumn("rule_text", F.trim("rule_text"))
    return insert_new(base, tidy, [F.lower("service"), F.col("rule_type"), F.trim("rule_text")])


def upsert_profile(base: DataFrame, changes: DataFrame) -> DataFrame:
    return latest_wins(base, changes.withColumn("key", F.lower(F.trim("key"))), "key")


def seed(base: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose natural key is missing are added; doing it again changes nothing."""
    return insert_new(base, rows, [F.col(k) for k in key])


def ingest(inputs: DataFrame, embed, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New memories, their entities, and the inputs that were refused (with error).

    inputs: user_id, text, type, entities, metadata, screenshot, extracted_text. ``embed`` adds a
    column embedding to a frame with a column text; equal texts are embedded once. Every stored row has
    an id of its own: a digest of all its fields, and the number of the repeat among wholly equal rows.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    checked = inputs.withColumn("error", text_error(F.col("text")))
    good = checked.where("error IS NULL").drop("error").withColumn("text", F.trim("text"))
    fields = good.columns
    key = F.sha2("text", 256)
    counted = materialize(good.groupBy(*fields).agg(F.count("*").alias("__n")).withColumn("__text", key), "inputs")
    vectors = materialize(embed(counted.select("text").distinct()).select(key.alias("__text"), "embedding"), "vectors")  # rows meet them by digest
    held = counted.withColumn("__repeat", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")
    failed = vectors.where("embedding IS NULL").select("__text")
    refused = checked.where("error IS NOT NULL").unionByName(held.join(failed, "__text", "left_semi").select(*fields).withColumn("error", F.lit("no embedding")))
    millis = F.unix_millis(moment.cast("timestamp"))
    named = held.withColumn("id", memory_id(millis, F.to_json(F.struct(*fields)), F.col("__repeat")))
    stored = named.join(vectors.where("embedding IS NOT NULL"), "__text")
    memories = stored.select(
        "id", "user_id", F.coalesce("type", F.lit("user_memory")).alias("type"), F.col("text").alias("source_text"), valid_metadata(F.col("metadata")).alias("metadata"),
        "screenshot", "extracted_text", "embedding", moment.alias("created_at"), moment.alias("updated_at"),
    )
    one = named.select("id", "entities", "__text").join(failed, "__text", "left_anti").select("id", F.posexplode(valid_entities(F.col("entities"))).alias("pos", "e"))
    entities = one.select(
        F.concat_ws("_", "id", F.lit("ent"), "pos").alias("id"), F.col("id").alias("memory_id"), F.col("e.value").alias("entity"), F.col("e.type").alias("type"),
        F.col("e.entity_type").alias("entity_type"), F.coalesce("e.normalized", "e.value").alias("normalized_value"), moment.alias("created_at"),
    )
    return memories, entities, refused


def update_memories(base: DataFrame, entities: DataFrame, changes: DataFrame, new_entities: DataFrame | None, embed, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Text (embedded anew), metadata, screenshot and extracted text may change; type and created_at may not.

    Entities are replaced for the ids in ``new_entities``.
    """
    vectors = embed(changes.where("source_text IS NOT NULL").select(F.col("source_text").alias("text")).distinct()).select(F.col("text").alias("source_text"), "embedding")
    given = changes.join(vectors, "source_text", "left").withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
    out = patch(base, given, "id", ["source_text", "metadata", "screenshot", "extracted_text", "embedding", "updated_at"])
    if new_entities is None:
        return out, entities
    touched = new_entities.select("memory_id").distinct()
    return out, entities.join(touched, "memory_id", "left_anti").unionByName(new_entities, allowMissingColumns=True)


def delete_memories(base: DataFrame, entities: DataFrame, ids: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the user's rows of these ids, and the rows that went."""
    gone = base.where(F.col("user_id") == user_id).join(ids.select("id"), "id", "left_semi")
    return base.join(gone.select("id"), "id", "left_anti"), entities.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"), gone


def create_tasks(base: DataFrame, tasks: DataFrame, now: datetime) -> DataFrame:
    return base.unionByName(tasks.withColumn("status", F.lit("running")).withColumn("started_at", F.lit(now).cast("timestamp_ntz")), allowMissingColumns=True)


def cancel_tasks(base: DataFrame, ids: Sequence[str], now: datetime) -> DataFrame:
    hit = F.col("id").isin(list(ids))
    return set_where(set_where(base, hit, "completed_at", F.lit(now).cast("timestamp_ntz")), hit, "status", F.lit("cancelled"))


def _files(spark: SparkSession, path: str):
    """Hadoop's path, its file system, and its file context (whose rename refuses to replace)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop.getFileSystem(conf).getUri(), conf)


def table_commits(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Number and version of a table's commits, oldest first; empty where nothing was committed."""
    path, fs, _ = _files(spark, f"{folder.rstrip('/')}/_commits")
    if not fs.exists(path):
        return []
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    out = []
    for f in fs.listStatus(path):
        if f.getPath().getName().isdigit():
            stream = fs.open(f.getPath())
            out.append((int(f.getPath().getName()), read(stream, "UTF-8")))
            stream.close()
    return sorted(out)


def commit(spark: SparkSession, folder: str, said: str, after: int) -> None:
    """Put ``said`` down as the commit that follows number ``after``; ValueError where another writer was first."""
    if any(n > after for n, _ in table_commits(spark, folder)):
        raise ValueError("another version was committed meanwhile")
    whole, fs, context = _files(spark, f"{folder}/_commits/.{uuid.uuid4().hex}")
    stream = fs.create(whole)
    stream.write(bytearray(said.encode()))
    stream.close()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(whole, _files(spark, f"{folder}/_commits/{after + 1:012d}")[0], none)  # one writer alone gets the number
    except Exception as error:
        fs.delete(whole, False)
        raise ValueError("another version was committed meanwhile") from error


def replace_table(df: DataFrame, folder: str, version: str, after: int | None = None) -> str:
    """Write a version under a table's folder and commit it; the version's path.

    ``after`` is the number of the commit that the change was made from (by default the newest when writing begins). Where another writer
    has committed since, nothing is committed and ValueError is raised. A write that fails commits nothing. The commit is a
    rename that does not replace, which is atomic on file systems like HDFS.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    if not version or "/" in version or version.startswith((".", "_")):
        raise ValueError(f"no name for a version: {version!r}")
    if after is None:
        after = max((n for n, _ in table_commits(spark, folder)), default=0)
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    commit(spark, folder, version, after)
    return path


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was committed last; only its files are read."""
    commits = table_commits(spark, folder)
    if not commits:
        raise ValueError(f"no version of {folder} was committed")
    return spark.read.parquet(f"{folder.rstrip('/')}/v={commits[-1][1]}")


def tidy_table(spark: SparkSession, folder: str, keep: int = 2, seconds: float = 86_400, now: datetime | None = None, named: Callable[[str], list[str]] = lambda said: [said]) -> list[str]:
    """Remove versions that none of the last ``keep`` commits names and that are older than ``seconds``; their names.

    Readers of versions that were replaced, and writers that have not committed yet, have that time to end.
    """
    root, fs, _ = _files(spark, folder.rstrip("/"))
    used = {f"v={version}" for _, said in table_commits(spark, folder)[-max(1, keep) :] for version in named(said)}
    before = ((now or datetime.now()).timestamp() - seconds) * 1000
    gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("v=") and f.getPath().getName() not in used and f.getModificationTime() <= before]
    for path in gone:
        fs.delete(path, True)
    return sorted(path.getName()[2:] for path in gone)
