"""Byte-level BPE by a table of distinct words: each word is encoded once, ids come back by position.

One pass over the texts splits them into the words that no merge crosses and packs, per block of some megabytes, each
text as positions in the block's list of distinct words, most frequent first. The words of all blocks meet by hash
bucket, where each distinct word is encoded once, and its ids go back to the blocks that have it. There every text
is put together by position, and decoded by joining its ids with the vocabulary's pieces, which every task has.
Texts themselves never shuffle; packed positions and word lists are several times smaller.
"""
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block, which one task holds with its words, and in a packed row of a block.
BLOCK_CHARS, ROW_CHARS = 16 << 20, 1 << 20
#: Rows of words that leave a block at a time.
WORD_ROWS = 128
#: Buckets of words: one task holds the distinct words of one bucket at a time.
BUCKETS = 1024
#: The split before byte-level merges that the vocabulary was made with (a fixed value of the file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _added(tokenizer) -> dict[str, int]:
    return {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}


#: Letters from here on: Unicode versions differ in which of them they know, so the tokenizer's own split decides.
NEWER = re.compile("[^\x00-\u052f]")


def splitter(tokenizer):
    """A function from a text without added tokens to its words."""
    import regex

    find, own = regex.compile(SPLIT).findall, tokenizer.pre_tokenizer.pre_tokenize_str
    return lambda text: [text[a:b] for _, (a, b) in own(text)] if NEWER.search(text) else find(text)


def words_of(text: str, find, cut) -> list[str]:
    """The words of a text, in order; they add up to it. Added tokens are words of their own."""
    if cut is None or not cut.search(text):
        return find(text)
    return [w for k, part in enumerate(cut.split(text)) for w in ([part] if k % 2 else find(part))]


PARTS = "block long, bucket int, doc_ids array<bigint>, head binary, body binary"


def pack(numbers) -> bytes:
    """Non-negative 32-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(np.asarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "bucket", "doc_ids", "head", "body"])


def _parts_of(found: list) -> Iterator[slice]:
    """The texts of a block by packed rows of about ROW_CHARS."""
    first, held = 0, 0
    for k in range(len(found)):
        held += len(found[k])
        if held >= ROW_CHARS // 4 or k == len(found) - 1:
            yield slice(first, k + 1)
            first, held = k + 1, 0


def _packed(block: int, at: dict, ids: list, found: list, buckets: int) -> Iterator[tuple]:
    """The rows of a block: its texts in parts of about ROW_CHARS (bucket -1), and its words by bucket. `found` and `at` are emptied on
    the way, so that what a block has becomes packed rows piece by piece and is not there twice."""
    own, counts = list(_parts_of(found)), np.zeros(len(at), np.int64)
    for part in own:
        counts += np.bincount(np.concatenate(found[part]), minlength=len(at))
    order = np.argsort(-counts, kind="stable").astype(np.int32)
    rank = np.empty(len(at), np.int32)
    rank[order] = np.arange(len(at), dtype=np.int32)
    for part in own:
        some = found[part]
        found[part] = [None] * len(some)
        yield block, -1, ids[part], pack([len(x) for x in some]), pack(rank[np.concatenate(some)])
        del some
    words = [w.encode("utf-8") for w in at]
    at.clear()
    dealt = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
    by_bucket = np.lexsort((rank, dealt))
    edges = np.flatnonzero(np.diff(dealt[by_bucket])) + 1
    for mine in np.split(by_bucket, edges) if len(words) else ():
        lens = [len(words[k]) for k in mine]
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(words[k] for k in mine))
        yield block, int(dealt[mine[0]]), [], pack(np.concatenate((lens, rank[mine]))), body


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Packed texts one by one, rows of words many at a time."""
    some = []
    for row in rows:
        some.append(row)
        if row[1] < 0 or len(some) == WORD_ROWS:
            yield _batch(some)
            some = []
    if some:
        yield _batch(some)


def _blocks(path: str, block_chars: int, buckets: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        find, added = splitter(tokenizer), _added(tokenizer)
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        del tokenizer  # its split is all that is needed; the vocabulary's memory serves the block
        block = TaskContext.get().partitionId() << 32
        at, ids, found, held = {}, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found.append(np.array([at.setdefault(w, len(at)) for w in words_of(text, find, cut)], np.int32))
                ids.append(doc_id)
                held += len(text)
                if held >= block_chars:
                    yield from _batches(_packed(block, at, ids, found, buckets))
                    block += 1
                    at, ids, found, held = {}, [], [], 0
        if ids:
            yield from _batches(_packed(block, at, ids, found, buckets))

    return run


def _word_rows(batches):
    for batch in batches:
        rows = batch.filter(pa.compute.greater_equal(batch.column(1), 0))
        yield pa.RecordBatch.from_arrays([rows.column(k) for k in (0, 1, 3, 4)], ["home", "bucket", "head", "body"])


def _encoded(path: str):
    """Rows of words, sorted by bucket, to rows of ids: each distinct word of a bucket is encoded once."""

    def run(batches):
        tokenizer = _tokenizer(path)
        bucket, known = None, {}
        for batch in batches:
            homes, heads, bodies = [], [], []
            for home, own, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                lens, ranks = np.split(unpack(head), 2)
                raw = zstandard.ZstdDecompressor().decompress(body)
                ends = np.cumsum(lens).tolist()
                words = [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                fresh = [w for w in words if w not in known]
                for w, x in zip(fresh, tokenizer.encode_batch([w.decode("utf-8") for w in fresh], add_special_tokens=False), strict=True):
                    known[w] = x.ids
                ids = [known[w] for w in words]
                homes.append(home)
                heads.append(pack(np.concatenate(([len(x) for x in ids], ranks))))
                bodies.append(pack([k for x in ids for k in x]))
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["home", "head", "body"])

    return run


class Lists:
    """Lists of numbers, one after the other in one array."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts

    def take(self, at: np.ndarray) -> np.ndarray:
        """The lists that `at` names, joined."""
        n = self.counts[at]
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def pieces(path: str) -> Lists:
    """The bytes of every id, by id. As large as the vocabulary file, whatever the data."""
    tokenizer, letters = _tokenizer(path), byte_letters()
    added = _added(tokenizer)
    found = {k: w.encode() if w in added else bytes(letters[c] for c in w) for w, k in tokenizer.get_vocab(with_added_tokens=True).items()}
    rows = [found.get(k, b"") for k in range(max(found) + 1)]
    return Lists(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64))


def decoded(ids: np.ndarray, vocabulary: Lists) -> str:
    """The text of ids: their pieces joined, as UTF-8 with the replacement sign for what is none."""
    return vocabulary.take(ids).tobytes().decode("utf-8", "replace")


ROWS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _assembled(vocabulary: Lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed texts and the encoded words of a block to its rows, a packed row of texts at a time; what is held stays packed."""
        heads, bodies, texts = [], [], []
        for batch in batches:
            for own, head, body in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "head", "body")), strict=True):
                if own is None:
                    heads.append(np.split(unpack(head), 2))
                    bodies.append(unpack(body))
                elif own:  # the block's words as they were come along with its texts, with no ids
                    texts.append((own, head, body))
        none = np.zeros(0, np.int32)
        counts, ranks, flat = (np.concatenate(x) if x else none for x in ([h[0] for h in heads], [h[1] for h in heads], bodies))
        del heads, bodies
        coded = Lists(flat, counts.astype(np.int64))
        place = np.empty(len(ranks), np.int64)
        place[ranks] = np.arange(len(ranks))
        while texts:
            own, head, body = texts.pop()
            ends = np.cumsum(unpack(head))
            lists = [coded.take(at) for at in np.split(place[unpack(body)], ends[:-1])]
            upto = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(lists).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), ids, pa.array([decoded(x, vocabulary) for x in lists], pa.string())], schema=ROWS)

    return run


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, ids, decoded.

    `tokenizer_path` is a byte-level BPE file of the tokenizers library, at the same place on every machine. ids are
    those of encoding without added special tokens, truncation or padding; a special token's string inside a text
    is that token. decoded is what decoding the ids gives, special tokens included. A null or empty text has no ids.
    Repeated rows and ids are rows of their own; an empty table gives an empty result. The rows of `docs` must come
    in the same order when a lost task runs again, as those of a stored table do.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = rows.mapInArrow(_blocks(tokenizer_path, block_chars, buckets), PARTS).repartition("block")
    words = parts.mapInArrow(_word_rows, "home long, bucket int, head binary, body binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(tokenizer_path), "home long, head binary, body binary")
    assembled = _assembled(pieces(tokenizer_path))
    # the union keeps the blocks in place, and no filter tells its side of `parts` from that of the words: texts are split and dealt once
    back = coded.select(F.col("home").alias("block"), F.lit(-1).alias("bucket"), F.lit(None).cast("array<bigint>").alias("doc_ids"), "head", "body")
    return parts.unionByName(back.repartition("block")).groupBy("block").applyInArrow(assembled, "doc_id long, ids array<int>, decoded string")
