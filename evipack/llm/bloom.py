"""Blocked Bloom filters of 64-bit words, built and probed with built-in functions.

A hash picks one word and two bits of it. `once` holds the bits that any hash set, `twice` those set two or more times, so a
hash that occurs again always finds both its bits in `twice`; others seldom do. Words are packed in blocks of an array.

Filters are kept by ranges of the hash, each of at most `RANGE_HASHES` hashes, so the filter of one range is of bounded size
(`RANGE_WORDS` words of 8 bytes) at every size of the data and can be broadcast. Rows are probed range by range, one job after
the other; rows stored in order of their hash let each job skip the pages of other ranges.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evipack.llm.scratch import written, written_parts

#: Filter bits for each hash: at most four hashes share a word on average.
BITS_PER_HASH = 16
#: Hashes that one range holds on average at most, and the words of its filter: 32 MB when broadcast.
RANGE_HASHES = 1 << 24
RANGE_WORDS = RANGE_HASHES * BITS_PER_HASH // 64
BLOCK = 1024


class Shape(NamedTuple):
    """Ranges of a filter and the words of each, powers of two."""

    ranges: int
    words: int


def shape_for(n: int, range_hashes: int = RANGE_HASHES) -> Shape:
    ranges = 1
    while ranges * range_hashes < n:
        ranges *= 2
    words = BLOCK
    while words * 64 < n // ranges * BITS_PER_HASH:
        words *= 2
    return Shape(ranges, words)


def range_of(h: Column, s: Shape) -> Column:
    """Number of the range, in the order of the hashes as signed numbers."""
    width = s.ranges.bit_length() - 1
    return F.lit(0) if width == 0 else (F.shiftright(h, 64 - width) + s.ranges // 2).cast("int")


def within(h: Column, r: int, s: Shape) -> Column:
    """Whether a hash lies in range r, as bounds that a scan can skip pages by."""
    step = (1 << 64) // s.ranges
    low, high = -(1 << 63) + r * step, -(1 << 63) + (r + 1) * step
    lower = F.lit(True) if r == 0 else h >= F.lit(low)
    return lower if r == s.ranges - 1 else lower & (h < F.lit(high))


def word_of(h: Column, s: Shape) -> Column:
    return h.bitwiseAND(F.lit(s.words - 1)).cast("int")


def mask_of(h: Column) -> Column:
    """Two different bits, from parts of the hash that pick neither word nor range."""
    first = F.shiftrightunsigned(h, 26).bitwiseAND(63)
    second = (first + F.shiftrightunsigned(h, 32).bitwiseAND(0xFFFF) % 63 + 1).bitwiseAND(63)
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, first.cast("int")).bitwiseOR(F.call_function("shiftleft", one, second.cast("int")))


def _blocks(words: DataFrame) -> DataFrame:
    """(part, block, bits) from (part, word, bits): arrays of BLOCK words."""
    own = F.map_from_entries(F.collect_list(F.struct((F.col("word") % BLOCK).alias("at"), "bits")))
    held = words.where("bits <> 0").groupBy("part", F.shiftrightunsigned("word", BLOCK.bit_length() - 1).alias("block")).agg(own.alias("own"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.element_at("own", i), F.lit(0).cast("long")))
    return held.select("part", "block", bits.alias("bits"))


def repeated(hashes: DataFrame, s: Shape) -> DataFrame:
    """Blocks of the filter of hashes that may occur twice, from a column `h` with a row per occurrence.

    Equal hashes combine before the shuffle. A word holds at most 2,016 different pairs of bits.
    """
    h = F.col("h")
    marks = hashes.where("h IS NOT NULL").groupBy(range_of(h, s).alias("part"), word_of(h, s).alias("word"), mask_of(h).alias("mask"))
    zero = F.lit(0).cast("long")

    def add(a: Column, x: Column) -> Column:
        again = a.once.bitwiseAND(x.mask).bitwiseOR(F.when(x.n > 1, x.mask).otherwise(zero))
        return F.struct(a.once.bitwiseOR(x.mask).alias("once"), a.twice.bitwiseOR(again).alias("twice"))

    start = F.struct(zero.alias("once"), zero.alias("twice"))
    own = marks.agg(F.count(F.lit(1)).alias("n")).groupBy("part", "word").agg(F.collect_list(F.struct("mask", "n")).alias("own"))
    return _blocks(own.select("part", "word", F.aggregate("own", start, add, lambda a: a.twice).alias("bits")))


def members(hashes: DataFrame, s: Shape) -> DataFrame:
    """Blocks of the filter of all hashes in the column `h`."""
    h = F.col("h")
    own = hashes.where("h IS NOT NULL").groupBy(range_of(h, s).alias("part"), word_of(h, s).alias("word"))
    return _blocks(own.agg(F.bit_or(mask_of(h)).alias("bits")))


def probed(rows: DataFrame, blocks: DataFrame, r: int, s: Shape, name: str = "suspect") -> DataFrame:
    """`rows` (with `h`, all of range r) plus `suspect`: whether the filter of that range has both bits. Rows stay in their place."""
    h = F.col("h")
    side = F.broadcast(blocks.where(F.col("part") == r).select(F.col("block").alias("block of words"), F.col("bits").alias("bits of words")))
    found = rows.join(side, F.shiftrightunsigned(word_of(h, s), BLOCK.bit_length() - 1) == F.col("block of words"), "left")
    bits = F.get("bits of words", word_of(h, s) % BLOCK)
    hit = F.coalesce(bits.bitwiseAND(mask_of(h)) == mask_of(h), F.lit(False))
    return found.withColumn(name, hit).drop("block of words", "bits of words")


def marked(rows: DataFrame, name: str, range_hashes: int = RANGE_HASHES, suspects_only: bool = False) -> DataFrame:
    """Stored `rows` (with `h`) plus `suspect`: whether the hash may occur twice or more; stored, range by range."""
    s = shape_for(rows.count(), range_hashes)
    blocks = written(repeated(rows, s), f"{name}-bloom")
    parts = (probed(rows.where(within(F.col("h"), r, s)), blocks, r, s) for r in range(s.ranges))
    return written_parts((p.where("suspect") if suspects_only else p for p in parts), f"{name}-marked")


def may_hold(rows: DataFrame, keys: DataFrame, name: str, range_hashes: int = RANGE_HASHES) -> DataFrame:
    """`rows` (with `h`) plus `suspect`: whether `h` may be among the stored `keys` (with `h`).

    For wide rows that are passed over once, so there is one filter. It never has more than RANGE_WORDS words: with more keys
    than RANGE_HASHES it lets through more and more rows that are no members, which the exact join behind it sorts out.
    """
    s = Shape(1, min(shape_for(keys.count(), 1 << 62).words, range_hashes * BITS_PER_HASH // 64))
    return probed(rows, written(members(keys, s), f"{name}-bloom"), 0, s)
