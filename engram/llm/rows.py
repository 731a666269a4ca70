"""Rows left out by key, without a shuffle of the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.storage import materialize

#: Bits for each key that goes, and all bits at most (8 MB).
KEY_BITS, MOST_BITS = 16, 1 << 26
#: Bits of one of Spark's bitmaps.
MAP_BITS = 1 << 15


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted_by_filter(rows: DataFrame, gone: DataFrame, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose bit is not set by any of ``gone`` (n distinct keys, not null), and the others, which may be among them."""
    bits = min(MOST_BITS, max(MAP_BITS, 1 << (KEY_BITS * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    part, held = free_name(rows, "__part"), free_name(rows, "__bits")
    bit = F.bitmap_bit_position(place)
    maps = gone.groupBy(F.bitmap_bucket_number(place).alias(part)).agg(F.bitmap_construct_agg(bit).alias(held))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = rows.withColumn(part, F.bitmap_bucket_number(place)).join(F.broadcast(maps), part, "left")  # MOST_BITS at most
    maybe = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) is not in ``gone``, a frame with that column.

    A table of bits, one set for each key that goes, is sent to the tasks (16 bits a key, 8 MB at most).
    Rows whose bit is not set stay where they are; only the others are shuffled to an anti-join, which
    decides. Beyond four million keys the bits fill up, so that more rows are shuffled, at most all.

    Defined results: a null key stays, also where ``gone`` has nulls; repeats in ``gone`` do not matter;
    repeated rows stay or go together; an empty table gives an empty result; other columns are left alone.
    """
    gone = materialize(gone.select(key).where(F.col(key).isNotNull()).distinct(), "gone")
    n = gone.count()
    if not n:
        return rows
    stay, asked = parted_by_filter(rows, gone, n, key)
    return stay.unionByName(asked.join(gone.hint("merge"), key, "left_anti").select(*rows.columns))
