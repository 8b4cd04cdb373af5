"""Line dedup with two Bloom filters, for hashes seen once and for hashes seen twice or more.

The texts are read once for the SHA-256 digests of the lines that count. The filters tell which digests may occur
again; only those suspects shuffle to be counted exactly and to choose the document that keeps the line. Documents that
lose no line pass straight through; only the others shuffle, to meet the digests they lose.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evipack.llm import bloom
from evipack.llm.scratch import written
from evipack.llm.skew import join_groups, join_suspects

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_key(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass").strip(BLANK).translate(LOWER)


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _line_digests(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, marks, found = [], [], []
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = {digest(k) for k in map(line_key, text.as_py().split("\n")) if _counts(k, min_chars)}
                ids += [doc_id] * len(own)
                marks += [mark] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 4)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.binary()), pa.array(np.ascontiguousarray(h))], ["doc_id", "mark", "digest", "h"])

    return run


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, range_hashes: int = bloom.RANGE_HASHES) -> DataFrame:
    """(doc_id, mark, digest): the digests of the lines that each of `rows` (doc_id, mark, text) loses, stored in its suspects."""
    lines = rows.mapInArrow(_line_digests(min_chars), "doc_id long, mark long, digest binary, h long").sortWithinPartitions("h")
    suspects = bloom.marked(written(lines, "lines"), "lines", range_hashes, suspects_only=True).drop("suspect", "h")
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    groups = suspects.groupBy("digest").agg(holders.alias("holders"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    common = written(groups.where(F.col("holders") >= min_docs).drop("holders"), "lines-common")
    return join_groups(suspects, common, "digest", "n").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "mark", "digest")


def _rebuilt(batches):
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            found = text.split("\n")
            lost = set(gone.as_py() or ())
            rest = [x for x in found if not lost or digest(line_key(x)) not in lost]
            kept.append("\n".join(rest) if len(rest) < len(found) else text)
            lines.append(len(found))
            dropped.append(len(found) - len(rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            ["doc_id", "kept_text", "n_lines", "n_dropped"],
        )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, range_hashes: int = bloom.RANGE_HASHES) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, kept_text, n_lines, n_dropped.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` and lower-cased in A-Z. Keys of `min_chars` code
    points or more found in `min_docs` documents or more lose all their lines except in the largest doc_id that
    holds them. Lines split at \\n; a null or empty text is one empty line. Rows with one doc_id are one document where
    documents are counted, and all of them keep the lines of which it is the largest holder; rows without a doc_id count as
    one document, which is never the largest. An empty table gives an empty result. `docs` is read twice and must give the
    same rows both times, as a stored table does.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The mark only spreads rows without a doc_id: what a line loses depends on its key and the doc_id alone.
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text"))
    of_row = F.struct("doc_id", "mark")
    own = repeated_lines(rows, min_chars, min_docs, range_hashes).groupBy(of_row.alias("of_row"))
    lost = own.agg(F.collect_set("digest").alias("lost"), F.count(F.lit(1)).alias("n"))
    lost = written(lost.withColumns({"n": F.floor(F.col("n") / F.size("lost")), "h": F.xxhash64("of_row")}), "lines-lost")
    tried = rows.select("doc_id", "text", of_row.alias("of_row")).withColumn("h", F.xxhash64("of_row"))
    found = join_suspects(bloom.may_hold(tried, lost, "lines-lost", range_hashes).drop("h"), lost.drop("h"), "of_row", "n")
    return found.select("doc_id", "text", "lost").mapInArrow(_rebuilt, "doc_id long, kept_text string, n_lines long, n_dropped long")
