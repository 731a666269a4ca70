"""Kept embeddings: a text that was embedded within the time to live does not reach the model again.

Tables of a part: ``vectors`` (digest, made_at, embedding) and ``uses`` (digest, made_at, used_at, hits, misses); a text is known by the
SHA-256 of its UTF-8 form. A use puts off the end of an entry. The first request of an unknown text is a miss, further ones of
the same batch are hits.

Defined results: null and blank texts have no embedding, are not asked for and not counted; a text for which the model gives no vector
is a miss each time and is tried again; vectors stay what they were while the entry lives, whatever the model is now.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType, TimestampNTZType

from engram.functions.embedding import embed_distinct
from engram.operators import kept
from engram.operators.filters import top
from engram.schema import DIMENSION
from engram.storage import materialize

#: Seconds an entry lives after its last use, and entries kept by default when parts are merged.
LIFE, MOST = 86_400, 1000
_VECTORS = StructType().add("digest", StringType()).add("made_at", TimestampNTZType()).add("embedding", ArrayType(DoubleType()))
_USES = StructType().add("digest", StringType()).add("made_at", TimestampNTZType()).add("used_at", TimestampNTZType()).add("hits", LongType()).add("misses", LongType())


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


class EmbeddingStore:
    """Embeddings kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, model: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, dimension: int = DIMENSION, life: float = LIFE):
        self.spark, self.folder, self.model, self.dimension, self.life = spark, folder.rstrip("/"), model, dimension, timedelta(seconds=life)

    def _read(self, seen: tuple[int, list[list]], table: str, schema: StructType) -> DataFrame:
        return kept.read(self.spark, self.folder, table, schema, seen[1]).drop("v")

    def _entries(self, seen: tuple[int, list[list]], now: datetime) -> DataFrame:
        """digest, made_at and used_at of the entries that live."""
        last = self._read(seen, "uses", _USES).where("made_at IS NOT NULL").groupBy("digest").agg(F.max(F.struct("used_at", "made_at")).alias("last"))
        return last.select("digest", "last.made_at", "last.used_at").where(F.col("used_at") >= F.lit(now - self.life).cast("timestamp_ntz"))

    def embed(self, texts: DataFrame, now: datetime) -> DataFrame:
        """text and embedding of each distinct text; new vectors and all uses are committed as one part.

        Digests and counts are what is compared with the store; texts that the store lacks are shuffled, once each, on their way to the model.
        """
        moment = F.lit(now).cast("timestamp_ntz")
        seen = kept.state(self.spark, self.folder)
        held = texts.select("text", digest(F.col("text")).alias("digest"))
        able = held.where(F.trim("text") != "")
        asked = able.groupBy("digest").agg(F.count("*").alias("n")).join(self._entries(seen, now).drop("used_at"), "digest", "left")
        asked = materialize(asked, "asked")
        lacking = able.join(asked.where("made_at IS NULL").select("digest"), "digest", "left_semi")

        def make(write) -> None:
            made = embed_distinct(lacking.select("text"), self.model, self.dimension).where("embedding IS NOT NULL")
            new = write("vectors", made.select(digest(F.col("text")).alias("digest"), moment.alias("made_at"), "embedding"))
            used = asked.join(new.select("digest", F.col("made_at").alias("new_at")), "digest", "left")
            misses = F.when(F.col("made_at").isNotNull(), 0).when(F.col("new_at").isNotNull(), 1).otherwise(F.col("n")).cast("long")
            write("uses", used.select("digest", F.coalesce("made_at", "new_at").alias("made_at"), moment.alias("used_at"), (F.col("n") - misses).alias("hits"), misses.alias("misses")))

        kept.add(self.spark, self.folder, seen, make)
        after = kept.state(self.spark, self.folder)
        wanted = asked.select("digest", F.coalesce("made_at", moment).alias("made_at"))
        vectors = self._read(after, "vectors", _VECTORS).join(wanted, ["digest", "made_at"], "left_semi")
        return held.distinct().join(vectors.drop("made_at"), "digest", "left").select("text", "embedding")

    def embedder(self, now: datetime) -> Callable[[DataFrame], DataFrame]:
        """``embed`` at a time, as ingest and updates take it."""
        return lambda texts: self.embed(texts, now)

    def figures(self) -> DataFrame:
        """One row: requests, hits, misses and hit_rate (null without a request) since the store began."""
        sums = self._read(kept.state(self.spark, self.folder), "uses", _USES).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
        total = F.col("hits") + F.col("misses")
        return sums.select(total.alias("requests"), "hits", "misses", F.when(total > 0, F.col("hits") / total).alias("hit_rate"))

    def merge(self, now: datetime, most: int | None = MOST) -> str:
        """All parts as one: entries that live, at most the ``most`` used last (None: all); figures stay as they were."""
        seen = kept.state(self.spark, self.folder)

        def make(write) -> None:
            live = self._entries(seen, now)
            live = materialize(live if most is None else top(live, F.desc("used_at"), F.asc("digest"), limit=most), "live")
            write("vectors", self._read(seen, "vectors", _VECTORS).join(live.drop("used_at"), ["digest", "made_at"], "left_semi").select(*_VECTORS.names))
            sums = self._read(seen, "uses", _USES).groupBy("digest").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
            counted = sums.join(live, "digest", "left")  # counts of entries that went stay, under no digest
            gone = F.col("made_at").isNull()
            own = counted.where(~gone).select(*_USES.names)
            rest = counted.where(gone).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
            none = rest.select(F.lit(None).cast("string").alias("digest"), F.lit(None).cast("timestamp_ntz").alias("made_at"), F.lit(None).cast("timestamp_ntz").alias("used_at"), "hits", "misses")
            write("uses", own.unionByName(none))

        return kept.add(self.spark, self.folder, seen, make, alone=True)
