"""Shards of about equal bytes as the leaves of a k-d tree over metadata.

A node that has to give k shards is split along its widest dimension, where a share of floor(k/2)/k of its bytes lies below. All nodes
of a level are split at once: bytes are summed by node, dimension and code (a histogram of at most `CODES` bins for each), which
tells the widest dimension and the code at which the weighted median falls; the bytes of that code are then summed by a hash of the
row (as many bins again), so that one value that holds most of a node is split as well. The cut is the border of such a bin that
lies nearest to the median, so a shard is off by a bin, which is a small part of it, or by a document.

Rows move only to be numbered; histograms combine before they shuffle.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evipack.llm.scratch import written

#: Bins of a dimension, and of the hash that splits equal codes.
CODES = 1 << 12
#: Bytes that a document weighs beside its text.
OVERHEAD = 16
#: Rows that are numbered in one task, about, and slices of a shard at least.
SLICE_ROWS, SLICES = 1 << 17, 8
#: Cuts of a level (one per node) that may be broadcast.
FEW_CUTS = 1 << 16
WHOLE = "whole"


def _places(docs: DataFrame, dims: tuple[str, ...], carry: bool = False) -> DataFrame:
    """Size, checksum, a number of each row, and its place in each dimension: a number, or the code of any other value. The last
    dimension is the size, in powers of two. The whole row comes along if `carry`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = []
    for k, name in enumerate(dims):
        kind, c = docs.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            c = c.cast("double")
            own.append(F.when(~F.isnan(c), c).alias(f"d{k}"))
        else:
            own.append(F.pmod(F.xxhash64(c), F.lit(CODES)).cast("int").alias(f"d{k}"))
    own += [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE)] if carry else []
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), *own)
    return rows.withColumn(f"d{len(dims)}", F.log2(F.col("size").cast("double")))


def _bounds(places: DataFrame) -> dict[str, tuple[float, float]]:
    """The least and greatest number of each dimension of numbers."""
    names = [f.name for f in places.schema if f.name.startswith("d") and f.name != "doc_id" and f.dataType == T.DoubleType()]
    found = places.agg(*[f(n).alias(f"{n} {k}") for n in names for k, f in enumerate((F.min, F.max))]).first()  # two numbers a dimension
    return {n: (found[f"{n} 0"] or 0.0, found[f"{n} 1"] or 0.0) for n in names}


def _coded(places: DataFrame, n_dims: int, bounds: dict[str, tuple[float, float]], shards: int) -> DataFrame:
    """Rows in the one node that gives all shards: a code in each dimension (null: the first), and the hash that splits equal codes."""
    codes = []
    for k in range(n_dims):
        low, high = bounds.get(f"d{k}", (0.0, 0.0))
        code = F.floor((F.col(f"d{k}") - low) / (high - low) * (CODES - 1)).cast("int") if high > low else F.lit(0)
        codes.append(F.coalesce(code if f"d{k}" in bounds else F.col(f"d{k}"), F.lit(0)))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(CODES)).cast("int")
    kept = [c for c in places.columns if c not in {f"d{k}" for k in range(n_dims)}]
    return places.select(*kept, F.array(*codes).alias("codes"), tie.alias("tie"), F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("k"))


def _cuts(rows: DataFrame, few: bool) -> DataFrame:
    """(first, dim, code, border) of each node that has to be split, stored: rows below `code` in that dimension go left, and so do those at
    it whose hash is below `border`."""
    node = Window.partitionBy("first", "dim")
    left = F.floor(F.col("k") / 2) / F.col("k")
    hist = rows.where("k > 1").select("first", "k", "size", F.posexplode("codes").alias("dim", "code")).groupBy("first", "k", "dim", "code").agg(F.sum("size").alias("bytes"))
    summed = hist.withColumns({"upto": F.sum("bytes").over(node.orderBy("code")), "goal": F.sum("bytes").over(node) * left})
    at = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("code", (F.col("upto") - F.col("bytes")).alias("below"), "goal")))
    medians = summed.groupBy("first", "k", "dim").agg(at.alias("at"), (F.max("code") - F.min("code")).alias("width"))
    widest = medians.groupBy("first", "k").agg(F.max_by(F.struct("dim", "at.*"), F.struct("width", -F.col("dim"))).alias("w")).select("first", "w.*")
    widest = F.broadcast(widest) if few else widest

    within = Window.partitionBy("first").orderBy("tie")
    held = rows.where("k > 1").join(widest, "first").where(F.get("codes", "dim") == F.col("code"))
    ties = held.groupBy("first", "dim", "code", "below", "goal", "tie").agg(F.sum("size").alias("bytes")).withColumn("upto", F.col("below") + F.sum("bytes").over(within))
    off = lambda reached, border: F.struct(F.abs(reached - F.col("goal")).alias("off"), border.alias("border"))
    borders = F.least(off(F.col("upto") - F.col("bytes"), F.col("tie")), off(F.col("upto"), F.col("tie") + 1))
    return written(ties.groupBy("first", "dim", "code").agg(F.min(borders).alias("best")).select("first", "dim", "code", F.col("best.border").alias("border")), "shard-cuts")


def _descended(rows: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """Rows one level down. A node is told by its first shard; its left half keeps that."""
    side = cuts.withColumnRenamed("first", "of")
    found = rows.join(F.broadcast(side) if few else side, F.col("first") == F.col("of"), "left")
    code = F.get("codes", "dim")
    right = F.coalesce((code > F.col("code")) | ((code == F.col("code")) & (F.col("tie") >= F.col("border"))), F.lit(False))
    half = F.floor(F.col("k") / 2)
    first, k = F.when(right, F.col("first") + half).otherwise(F.col("first")), F.when(F.col("of").isNull(), F.col("k")).when(right, F.col("k") - half).otherwise(half)
    return found.select(*[c for c in rows.columns if c not in ("first", "k")], first.alias("first"), k.alias("k"))


def _levels(shards: int) -> list[bool]:
    """For each level of the tree whether its cuts are few enough to be broadcast."""
    return [1 << level <= FEW_CUTS for level in range((shards - 1).bit_length())]


def _grown(docs: DataFrame, shards: int | None, target_bytes: int | None, dims: tuple[str, ...]) -> tuple[DataFrame, list[DataFrame], dict, int]:
    """The rows with their shard (`first`), the cuts of each level, the bounds of the dimensions, and the number of shards."""
    if (shards is None) == (target_bytes is None) or (shards or target_bytes) < 1:
        raise ValueError("give a number of shards or the bytes of one")
    places = written(_places(docs, dims), "shard-places")
    if shards is None:
        shards = max(1, -(-(places.agg(F.sum("size")).first()[0] or 0) // target_bytes))  # one number
    bounds, cuts = _bounds(places), []
    rows = _coded(places, len(dims) + 1, bounds, shards)
    for few in _levels(shards):
        cuts.append(_cuts(rows, few))
        rows = written(_descended(rows, cuts[-1], few), "shard-rows")
    return rows, cuts, bounds, shards


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang"), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text and the columns in `dims`; others are ignored): doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text and `OVERHEAD`; shards, numbered from 0, hold about equal sizes: `shards` of them, or as many
    as `target_bytes` each ask for. dims are columns of documents, numbers or anything else; the size is one more dimension.
    slot counts the rows of a shard from 0, without gaps.

    A null text weighs as an empty one; a null, or a number that is none, is a value of its own, the lowest. Null or repeated ids do
    no harm, as rows are told by their place in the input; so rows that are alike in everything are spread as well, and the same
    files read in the same splits give the same shards. With fewer rows than shards, or a document larger than a shard, some
    shards stay empty. An empty table gives an empty result.
    """
    rows = _grown(docs, shards, target_bytes, dims)[0].select("doc_id", "size", "text_crc32", "row", F.col("first").cast("int").alias("shard"))
    slices = max(SLICES, -(-rows.count() // slice_rows))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    turn = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row"))
    return rows.join(starts, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + turn - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang"), file_bytes: int = 1 << 28) -> int:
    """Write `docs`, all columns, to `folder`/shard=N as Parquet, and return the number of shards.

    Texts find their shard by the tree's cuts where they lie, and shuffle once to be written, a shard in files of about
    `file_bytes`. A column `shard` of the documents gives way to the shard's number. Null and repeated rows are taken as in
    kd_shards; an empty table gives no files."""
    grown, cuts, bounds, shards = _grown(docs, shards, target_bytes, dims)
    files = max(1, -(-(grown.agg(F.sum("size")).first()[0] or 0) // (shards * file_bytes)))  # one number
    rows = _coded(_places(docs, dims, carry=True), len(dims) + 1, bounds, shards)
    for few, cut in zip(_levels(shards), cuts, strict=True):
        rows = _descended(rows, cut, few)
    dealt = rows.withColumn("shard", F.col("first").cast("int")).repartition("shard", F.pmod(F.col("tie"), F.lit(files)))
    dealt.select("shard", *[F.col(f"{WHOLE}.`{c}`") for c in docs.columns if c != "shard"]).write.partitionBy("shard").parquet(folder)
    return shards
