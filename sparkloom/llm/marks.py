"""A bitmap of fixed size that parts a table by whether its keys can be among a set of keys, before anything is shuffled.

The bitmap has BITS bits whatever the number of keys, one set for each key's hash, so it can always be broadcast. A row
whose bit is clear is surely not among the keys; the others go on to an exact join. With more keys than bits the
bitmap parts less and less, and the exact join alone decides: results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved

#: 2 MB, in pieces of 32768 bits as Spark's bitmap functions make them.
BITS = 1 << 24


def _place(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def marks(keys: DataFrame, on: list[str]) -> DataFrame:
    """(piece, bits): the bitmap of the rows of ``keys``, at most BITS / 32768 rows. Written at once; the caller drops it."""
    bits = keys.select(F.bitmap_bucket_number(_place(on)).alias("piece"), F.bitmap_bit_position(_place(on)).alias("bit"))
    return saved(bits.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")), "marks")


def parted(df: DataFrame, on: list[str], bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose columns ``on`` may be among the keys of the bitmap, and those where they are surely not.

    Each of the two reads ``df`` once more, without a shuffle; columns of any names are kept.
    """
    place, piece, bits = (fresh(df, name) for name in ("place", "piece", "bits"))
    pieces = F.broadcast(bitmap.select(F.col("piece").alias(piece), F.col("bits").alias(bits)))  # of fixed size
    placed = df.withColumn(place, _place(on)).withColumn(piece, F.bitmap_bucket_number(place)).join(pieces, piece, "left")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod((byte / F.pow(F.lit(2), bit % 8)).cast("int"), F.lit(2)) == 1, F.lit(False))
    return tuple(placed.where(test).select(*df.columns) for test in (hit, ~hit))
