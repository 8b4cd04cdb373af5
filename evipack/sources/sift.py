"""Wide rows told apart by their key where they lie: a broadcast bitmap of hashed keys tells which rows cannot have one of many keys.

Only the others meet the keys in a join, so what shuffles follows the rows that are asked for and not the table. A bitmap leaves out no row
wrongly; the few it lets through too many are sorted out by the join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's; bits for each key: of the rows with other keys one in so many is let through; and of all bitmaps, which
#: are 32 MB at most: beyond that more rows are let through.
SHEET, BITS, MOST = 1 << 15, 32, 1 << 28


def places(keys: DataFrame) -> int:
    """How many bits `keys` get, all in all; none if there are no keys."""
    n = keys.count()
    return min(MOST, BITS * max(SHEET, n)) if n else 0


def told(rows: DataFrame, keys: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """`rows` with `maybe`: false if their source_ref is surely not in `keys`."""
    if not bits:
        return rows.withColumn("maybe", F.lit(False))
    place = F.pmod(F.xxhash64("source_ref", F.lit(seed)), F.lit(bits))
    sheets = keys.select(place.alias("place")).groupBy(F.expr(f"place div {SHEET}").alias("sheet")).agg(F.bitmap_construct_agg(F.col("place") % SHEET).alias("bitmap"))
    own = rows.withColumn("place", place).withColumn("sheet", F.expr(f"place div {SHEET}"))
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, CAST(place % {SHEET} DIV 8 AS int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))
    return own.join(F.broadcast(sheets), "sheet", "left").withColumn("maybe", maybe).select(*rows.columns, "maybe")


def few(rows: DataFrame, keys: DataFrame, bits: int | None = None, seed: int = 0) -> DataFrame:
    """The rows whose source_ref is in `keys` (source_ref), and few others, for a join that follows."""
    return told(rows, keys.select("source_ref"), places(keys) if bits is None else bits, seed).where("maybe").drop("maybe")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose source_ref is not in `keys`. Of those that may be, only keys shuffle, but for the few that were let through too many."""
    keys = keys.select("source_ref")
    bits = places(keys)
    each = told(rows, keys, bits)
    doubtful = each.where("maybe").drop("maybe")
    others = doubtful.select("source_ref").join(keys, "source_ref", "left_anti")
    back = few(doubtful, others, bits, 1).join(others, "source_ref", "left_semi").select(*rows.columns)
    return each.where("NOT maybe").drop("maybe").unionByName(back)
