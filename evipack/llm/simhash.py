"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is cut into four segments of 16 bits on a ring. Two fingerprints with at most three
differing bits have a starting segment from which every chain of 1, 2, 3 and 4 consecutive segments holds at
most 0, 1, 2 and 3 differing bits (the strong form of the pigeonhole principle). So equal starting segments
propose candidates, the chain budgets prune them one after the other, and what survives has passed the full Hamming check.

Equal fingerprints count once. A bucket of more than `BUCKET` fingerprints is split by the segments of its
remaining bits, of which again one must be equal, until it is small; nothing is capped or dropped.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evipack.llm import bloom
from evipack.llm.components import connected_components
from evipack.llm.scratch import written
from evipack.llm.skew import join_groups, join_suspects, shielded

SEED = 42
SEGMENTS, SEGMENT_BITS, MAX_BITS = 4, 16, 3
#: Largest number of fingerprints compared with each other in one bucket, and the least that it can be: so many different
#: fingerprints may be left where all splits are used up.
BUCKET, LEAST_BUCKET = 512, 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of 3-word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-3] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[2:].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """(doc_id, digest, fp) for each row; fp holds the 64 bits as a signed long. A null text counts as empty. digest is null
    unless a binary column is given, which comes along."""
    own = F.lit(None).cast("binary") if digest is None else digest
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), own.alias("digest"))
    return rows.mapInArrow(_fingerprints, "doc_id long, digest binary, fp long")


def _links_in(values: np.ndarray) -> list[tuple[int, int]]:
    """Links between positions of one bucket that connect what is within reach in it.

    `values` are rotated so that the bucket's equal segment is lowest. Pairs must keep the budget of each chain of
    consecutive segments from the equal one on; pairs that exceed one are not looked at again, and those that keep the
    longest one have passed the full check.
    """
    if len(values) < 2:
        return []
    low = np.uint64((1 << (2 * SEGMENT_BITS)) - 1)
    short = values & low
    a, b = np.nonzero(np.triu(np.bitwise_count(short[:, None] ^ short[None, :]) <= 2 * MAX_BITS // SEGMENTS, 1))
    for chain in range(3, SEGMENTS + 1):
        mask = np.uint64((1 << (SEGMENT_BITS * chain)) - 1)
        near = np.bitwise_count((values[a] ^ values[b]) & mask) <= chain * MAX_BITS // SEGMENTS
        a, b = a[near], b[near]
    root, out = list(range(len(values))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def _bucket_links(frames):
    for frame in frames:
        a, b = [], []
        for turn, fps in zip(frame["turn"], frame["fps"], strict=True):
            raw = np.array(fps, dtype=np.int64)
            fp, shift = raw.view(np.uint64), np.uint64(SEGMENT_BITS * turn)
            rotated = fp if turn == 0 else (fp >> shift) | (fp << np.uint64(64 - int(shift)))
            for x, y in _links_in(rotated):
                a.append(raw[x])
                b.append(raw[y])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _start(nodes: DataFrame) -> DataFrame:
    """A row for each fingerprint and starting segment: turn, path (the bucket), rest (the bits not yet used)."""
    turns = F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("turn")
    rotated = F.expr(f"CASE WHEN turn = 0 THEN fp ELSE shiftrightunsigned(fp, {SEGMENT_BITS} * turn) | shiftleft(fp, 64 - {SEGMENT_BITS} * turn) END")
    low = (1 << SEGMENT_BITS) - 1
    return nodes.select("fp", turns).withColumn("bits", rotated).select(
        "fp", "turn",
        F.concat_ws(":", "turn", F.hex(F.col("bits").bitwiseAND(low))).alias("path"),
        F.shiftrightunsigned("bits", SEGMENT_BITS).alias("rest"),
    )


def _split(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Each row of a large bucket goes to four buckets, by the four parts of its remaining bits; the other parts stay."""
    part = -(-width // SEGMENTS)
    low = (1 << part) - 1
    parts = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("part"))
    below = F.expr(f"rest & (shiftleft(1L, {part} * part) - 1)")
    above = F.expr(f"shiftleft(shiftrightunsigned(rest, {part} * part + {part}), {part} * part)")
    value = F.expr(f"shiftrightunsigned(rest, {part} * part) & {low}L")
    return parts.select("fp", "turn", F.concat_ws(":", "path", "part", F.hex(value)).alias("path"), below.bitwiseOR(above).alias("rest")), width - part


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly what differs in at most three bits.

    They are a spanning set: two fingerprints within reach are connected, though not always by a link of their own.
    """
    rows, width, found, bucket = _start(nodes), 64 - SEGMENT_BITS, [], max(bucket, LEAST_BUCKET)
    while True:
        rows = written(rows, "simhash-places")
        sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "simhash-sizes")
        shared = written(join_groups(rows, sizes, "path", "size"), "simhash-buckets")
        small = shared.where(F.col("n") <= bucket).groupBy("path", "turn").agg(F.collect_list("fp").alias("fps"))
        found.append(small.select("turn", "fps").mapInPandas(_bucket_links, "a long, b long"))
        large = shared.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        rows, width = _split(large.drop("n"), width)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _classes(rows: DataFrame, bucket: int) -> DataFrame:
    """(fp, n, component_id, keeper) of the stored `rows` (doc_id, digest, fp), stored: how many rows have the fingerprint, the
    smallest doc_id of its component, and the (doc_id, digest) of the row that stands for it."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = written(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = connected_components(near_links(nodes, bucket)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("size")), "simhash-components")
    named = join_groups(rooted.select("fp", "n", "root"), least, "root", "size")
    return written(named.select("fp", "n", F.col("keeper.doc_id").alias("component_id"), "keeper"), "simhash-named")


def simhash_near_dedup(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, fingerprint, component_id.

    Fingerprints link at three or fewer differing bits; component_id is the smallest doc_id that links reach, the
    row's own included. A null or wordless text has fingerprint zero, linked like any other. A null doc_id never
    names a component (a component without any other has null). Repeated rows share their component. An empty table gives
    an empty result.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    found = join_groups(rows, _classes(rows, bucket), "fp", "n")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` that stand for their component, with all columns: of each component the row with the smallest doc_id
    (a null one last), then the smallest digest of the text.

    Rows are told by doc_id and digest, so repeated or null ids drop no other text; rows alike in both stay together.
    Rows that a Bloom filter of the dropped ones does not know pass straight through; only the others shuffle. `docs` is
    read twice and must give the same rows both times, as a stored table does.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    mark = F.struct(F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    rows = written(fingerprints(docs, digest), "simhash-rows")
    found = join_groups(rows, _classes(rows, bucket), "fp", "n")
    lost = found.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest"))))
    lost = lost.select(mark.alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    lost = written(lost.withColumns({"h": F.xxhash64("mark"), "lost": F.lit(True)}), "simhash-lost")
    own, back = shielded(docs)
    named = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    named = named.withColumn("mark", mark).drop("doc_id", "digest").withColumn("h", F.xxhash64("mark"))
    tried = bloom.may_hold(named, lost, "simhash-lost").drop("h")
    return join_suspects(tried, lost.select("mark", "lost", "n"), "mark", "n").where(F.col("lost").isNull()).select(*back)
