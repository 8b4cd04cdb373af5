"""Awkward documents that every operator must take, and plain-Python forms of what the operators compute."""

import random
import re

from pyspark.sql import functions as F

CLASHING = ("fp", "h", "h2", "word", "twice", "suspect", "digest", "chars", "keep_id", "kept", "block", "bucket", "ids", "shard", "size", "target", "taken", "turn", "quota", "n", "path", "root", "lost", "spans", "base", "anomaly", "host", "tree", "salt", "template", "copies", "copy", "passes", "rest", "dropped_id")
BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHARED = "This line is long enough to count and is shared by many documents"


def documents():
    """(doc_id, text, lang, source, n_chars) rows: nulls, empty, blank, very long, copies, near copies, repeated rows."""
    draw = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]
    prose = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(60, 200))) + "." for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    near = prose[0].split()
    for k in range(6):
        changed = list(near)
        changed[20 + k] = "other"
        rows.append((100 + k, " ".join(changed), "en", "s0", None))
    rows += [(200 + k, f"{prose[1]}\n  {SHARED.upper() if k % 2 else SHARED}\t\nown {k}\n{SHARED}", "en", "s1", 1) for k in range(6)]
    rows += [
        (300, None, None, None, None), (301, "", "en", "s2", 0), (302, " \t\n\x0b\x0c\r ", "en", None, 7), (303, "one", "en", "é", 3), (304, "ONE  two", "en", "s0", 8),
        (305, prose[3], "en", "s1", 1), (306, prose[3].replace(" ", "\n"), "en", "s1", 1), (307, prose[3] + "   ", "fr", "s2", 1), (307, prose[3] + "   ", "fr", "s2", 1),
        (308, " ".join(draw.choice(vocabulary) for _ in range(60_000)), "en", "s0", 1), (309, "x" * 300_000, "en", "s0", 1), (None, "a document without an id " * 20, "en", "s1", 1),
        (310, "mail a.b@c.d_e@f.gh or é@x.y, ip 10.0.0.1 1.2.3.4.5 300.1.1.1, card 4111 1111 1111 1111, call +1 (743) 555-3824. <|endoftext|> Licensed under CC BY-NC 4.0.", "en", "s2", 1),
        (311, "日本語 テキスト ԱԲ   ok nbsp 🙂🙂 don't\r\n\n x", "ja", "s2", 1), (312, "### $$$ *** " * 40, "en", "s2", 1), (313, "again and again " * 50, "en", "s2", 1),
    ]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return frame(spark, [])


def words(text):
    return WORD.findall(text or "")
