"""Fill-in-the-middle: texts cut at unit boundaries into prefix, middle and suffix, and put together again in another order.

Boundaries are found by SWAR words: a batch of UTF-8 is viewed as 64-bit words, arithmetic on whole words sets the high bit of
every byte that ends a unit, and the bits of each word are counted. The word with a wanted boundary is searched in the running
counts; the byte within it follows from sums of marks, again by arithmetic on one word. No text is split into a list.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONES, LOW, HIGH = (np.uint64(0x0101010101010101 * b) for b in (0x01, 0x7F, 0x80))
NEWLINES = np.uint64(0x0101010101010101 * 0x0A)
#: Bytes of text that are viewed as words at once, more for a longer text.
BLOCK_BYTES = 1 << 22
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a newline. Adding 7F to the low bits of a byte carries into the high one unless all are zero."""
    x = words ^ NEWLINES
    return ~(((x & LOW) + LOW) | x | LOW)


def character_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that does not continue a character (10xxxxxx)."""
    return (~words | (words << np.uint64(1))) & HIGH


def character_ends(words: np.ndarray) -> np.ndarray:
    starts = character_starts(words)
    return (starts >> np.uint64(8)) | (np.append(starts[1:], HIGH) << np.uint64(56))


class Marks:
    """Marked bytes with counts: how many lie before a place, and where the r-th lies."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, place: np.ndarray) -> np.ndarray:
        word, bits = place >> 3, ((place & 7) << 3).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bits) - np.uint64(1)))

    def select(self, r: np.ndarray) -> np.ndarray:
        """Places of the marks numbered r, from 1."""
        word = np.searchsorted(self.before, r) - 1
        earlier = (r - self.before[word] - 1).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * ONES  # byte j: marks in bytes 0 to j
        return 8 * word + np.bitwise_count(((earlier * ONES | HIGH) - sums) & HIGH)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> list[np.ndarray]:
    words = np.concatenate((data, np.zeros(16 - len(data) % 8, np.uint8))).view("<u8")
    units, chars = Marks(line_ends(words) if unit == "line" else character_ends(words)), Marks(character_starts(words))
    first, whole = units.rank(starts), units.rank(ends) - units.rank(starts)
    open_end = (ends > starts) & (units.rank(ends) == units.rank(np.maximum(ends - 1, starts)))
    n = whole + open_end
    picks = np.sort(np.stack((h1 % (n + 1), h2 % (n + 1))), axis=0)
    places = []
    for k in picks:
        inner = (k > 0) & (k <= whole)
        place = np.where(k == 0, starts, ends)
        place[inner] = units.select((first + k)[inner]) + 1
        places.append(place)
    ranks = [chars.rank(p) for p in (starts, *places)]
    return [n, places[0] - starts, places[1] - places[0], ranks[1] - ranks[0], ranks[2] - ranks[1]]


def _cutter(unit: str, block_bytes: int):
    names = ("n", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars")

    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        wide = pa.types.is_large_binary(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        draws = [np.asarray(h.to_numpy(zero_copy_only=False), np.int64) for h in (h1, h2)]
        found, row = [[] for _ in names], 0
        while row < len(text):
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
            own = offsets[row : upto + 1]
            block = _cut(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0], draws[0][row:upto], draws[1][row:upto], unit)
            for held, values in zip(found, block, strict=True):
                held.append(values)
            row = upto
        return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in found], list(names))

    return F.arrow_udf(cut, ", ".join(f"{n} long" for n in names))


def _check(unit: str, sentinels: tuple[str, str, str]) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    clash = any(a[:1] in b[1:] for a in sentinels for b in sentinels) or any(a != b and a.startswith(b) for a in sentinels for b in sentinels)
    if clash or "" in sentinels or len(set(sentinels)) < 3:
        raise ValueError("sentinels are three strings, none the beginning of another, whose first characters occur only there")


def fill_in_middle(
    docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, salt: str = "7:", sentinels: tuple[str, str, str] = SENTINELS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n, form, prefix_chars, middle_chars, output.

    A text has n units, lines with their \\n or characters. Four numbers from the hash of `salt` and doc_id decide: the first two,
    modulo n + 1, after how many units prefix and middle end; the third, whether the text is cut at all (`rate` of 100); the
    fourth, its form: `spm` of 100 come as suffix, prefix, middle, the others (psm) as prefix, suffix, middle, each part behind its
    sentinel (prefix, suffix, middle). Empty texts and texts that hold a sentinel stay as they are (plain; lengths null).

    A null text counts as empty, a null doc_id as one without digits. Repeated rows come out alike; rows with one doc_id and
    different texts share the four numbers. Rows never move between tasks; an empty table gives an empty result. Texts are cut as bytes, in
    blocks of `block_bytes` or one longer text, so a task holds a few times the size of an Arrow batch.
    """
    _check(unit, sentinels)
    digits = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *draws)
    rows = rows.withColumn("cut", _cutter(unit, block_bytes)("text", "h1", "h2"))
    plain = (F.length("text") == 0) | (F.col("h3") % 100 >= rate)
    for s in sentinels:
        plain = plain | F.contains("text", F.lit(s).cast("binary"))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "cut", form.alias("form"))
    one, two = F.col("cut.prefix_bytes"), F.col("cut.middle_bytes")
    part = lambda start, size: F.col("text").substr((start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = (
        F.concat(F.lit(sentinels[k]).cast("binary"), p) for k, p in ((0, part(F.lit(0), one)), (2, part(one, two)), (1, part(one + two, F.length("text"))))
    )
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    known = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    return rows.select("doc_id", F.col("cut.n").alias("n"), "form", known("prefix_chars"), known("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `output` was made of, from the output and its form alone."""
    p, s, m = sentinels
    between = lambda first, last: F.substring_index(F.substring_index(output, last, 1), first, -1)
    middle = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
