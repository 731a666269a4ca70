"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_made = threading.local()
_lock = threading.Lock()
_before: dict[tuple[int, str], list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where unset, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="engram-")
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    for folders in getattr(_made, "open", ()):
        folders.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by new_folder once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def with_settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while. Where several threads ask for the same one, the last to end puts back what was there before the first."""
    session = spark._jsparkSession.hashCode()
    keys = [(session, k) for k in own]
    with _lock:
        for key in keys:
            held = _before.setdefault(key, [spark.conf.get(key[1], None), 0])
            held[1] += 1
            spark.conf.set(key[1], own[key[1]])
    try:
        yield
    finally:
        with _lock:
            for key in keys:
                held = _before[key]
                held[1] -= 1
                if held[1] == 0:
                    del _before[key]
                    if held[0] is None:
                        spark.conf.unset(key[1])
                    else:
                        spark.conf.set(key[1], held[0])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor, and lets Spark drop the
    shuffle files of the phase just written.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/t"
    with with_settings(spark, {_CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Let Spark put a Bloom filter of a small side's keys (8 MB at most) before the shuffle of a large one, whatever their sizes."""
    own = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    }
    with with_settings(spark, own):
        yield


def settle(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` gives, written; the folders of the phases on the way to it are removed."""
    folders: list[str] = []
    _made.open = [*getattr(_made, "open", ()), folders]
    try:
        df = make()
    finally:
        _made.open = _made.open[:-1]
    out = materialize(df, name)
    for path in folders:
        remove_folder(spark, path)
    return out


def with_row_key(df: DataFrame, id_col: str = "doc_id", key: str = "row_key") -> DataFrame:
    """Add a column that is unique per row and the same whenever the frame is read again.

    Where ids are whole numbers, unique and not null, the key is the id. Otherwise (a check over
    the id column alone tells) the rows are written once with generated numbers, so that repeated
    ids, null ids and wholly repeated rows stay apart in later joins. A column of that name is replaced.
    """
    if not isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
    ids = df.select(F.col(id_col).cast("long").alias("i")).groupBy("i").count()
    worst = ids.agg(F.max(F.when(F.col("i").isNull(), F.lit(2)).otherwise(F.col("count")))).first()[0]
    if worst is None or worst <= 1:
        return df.withColumn(key, F.col(id_col).cast("long"))
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
