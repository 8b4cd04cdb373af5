"""Exact dedup by two-pass Bloom filtering, on built-in functions only.

Pass one reads the texts, keeps a digest per row and marks in a Bloom filter which digests may occur twice.
Pass two probes the filter: only suspects shuffle for grouping, all other rows pass straight through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evipack.llm import bloom
from evipack.llm.scratch import written
from evipack.llm.skew import join_groups, join_suspects, shielded

WHITE = r"[\x20\x09-\x0D]+"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(F.regexp_replace(_text(), WHITE, ""), 256))


def _marked(docs: DataFrame, range_hashes: int) -> DataFrame:
    """(doc_id, chars, digest, h, suspect) of each row, stored."""
    rows = docs.select("doc_id", F.length(_text()).alias("chars"), _digest().alias("digest")).withColumn("h", F.xxhash64("digest"))
    return bloom.marked(written(rows.sortWithinPartitions("h"), "exact-rows"), "exact", range_hashes)


def _groups(marked: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id) of the suspects, stored."""
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    kept = F.min(order).getField("doc_id").alias("keep_id")
    return written(marked.where("suspect").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), kept), "exact-groups")


def exact_dedup(docs: DataFrame, range_hashes: int = bloom.RANGE_HASHES) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of `[\\x20\\x09-\\x0D]`. Of equal texts the
    row with the most code points stays, then the smallest doc_id. A null text counts as empty; a null doc_id
    comes after all others. Rows that repeat one doc_id and one text count in group_size and are kept or dropped
    together; rows with one doc_id and different texts are judged apart. An empty table gives an empty result.
    """
    marked = _marked(docs, range_hashes)
    groups = _groups(marked).withColumn("n", F.col("group_size"))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    repeated = join_groups(marked.where("suspect"), groups, "digest", "n").select(*columns)
    alone = marked.where(~F.col("suspect")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(*columns)
    return alone.unionByName(repeated)


def keep_first_copies(docs: DataFrame, range_hashes: int = bloom.RANGE_HASHES) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns.

    A second filter holds the digests that do repeat. Rows it does not know pass straight through; only the others shuffle, by
    digest, and stay if their group names them. A row is told by its doc_id and digest, so repeated or null ids drop no
    other text. `docs` is read twice and must give the same rows both times, as a stored table does.
    """
    groups = _groups(_marked(docs, range_hashes)).where("group_size > 1").withColumn("h", F.xxhash64("digest"))
    own, back = shielded(docs)
    rows = docs.select(*own, F.col("doc_id").alias("id of row"), _digest().alias("digest")).withColumn("h", F.xxhash64("digest"))
    tried = bloom.may_hold(rows, groups, "exact-repeats", range_hashes).drop("h")
    side = groups.select("digest", "keep_id", F.lit(True).alias("repeats"), "group_size")
    found = join_suspects(tried, side, "digest", "group_size")
    return found.where(F.col("repeats").isNull() | F.col("id of row").eqNullSafe(F.col("keep_id"))).select(*back)
