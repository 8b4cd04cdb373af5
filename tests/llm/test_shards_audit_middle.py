"""Sharding, the filter audit and fill-in-the-middle on awkward documents, against plain Python."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evipack.llm import filter_audit, middle, queries, sharding
from tests.llm import cases

DOCS = cases.documents() + [
    (400, "a\nb\n\n\nc", "en", "s1", 7), (401, "\n", "en", "s1", 1), (402, "one line\n", "en", "s1", 9), (403, "has <P> in it\nsecond\n", "en", "s1", 20), (404, "<<S\n<M\n<P\n", "en", "s1", 8),
    (405, "é\n日本\n🙂🙂\n" * 40, "ja", "s1", 9), (406, "\r\n\r\n\x0a\x8aਊ\n", "en", "s1", 9), (407, "x\n" * 5000, "en", "s1", 9), (408, "SHOUT " * 120, "de", "s1", 9), (409, "SHOUT " * 120, "en", "s1", 9),
]
SHORT = [r for r in DOCS if len(r[1] or "") < 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, DOCS)


def units_of(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def cut(doc_id, text, unit, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    own = units_of(text, unit)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(own) + 1), h[1] % (len(own) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return doc_id, len(own), "plain", None, None, text
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    first, last, mid = (x + y for x, y in zip(marks, (p, s, m), strict=True))
    if h[3] % 100 < spm:
        return doc_id, len(own), "spm", len(p), len(m), last + first + mid
    return doc_id, len(own), "psm", len(p), len(m), first + last + mid


@pytest.mark.parametrize("unit,block,rate,spm", [("line", 1 << 22, 100, 50), ("line", 50, 60, 0), ("character", 1 << 22, 100, 100), ("character", 1000, 90, 30)])
def test_middle(docs, unit, block, rate, spm):
    found = middle.fill_in_middle(docs, unit=unit, rate=rate, spm=spm, block_bytes=block)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((cut(r[0], r[1], unit, rate, spm) for r in DOCS), key=str)
    again = found.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == sorted(((r[0], r[1] or "") for r in DOCS), key=str)


def test_middle_sentinels(docs):
    marks = ("[PRE]", "[SUF]", "[MID]")
    found = middle.fill_in_middle(docs, sentinels=marks)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((cut(r[0], r[1], "line", marks=marks) for r in DOCS), key=str)
    back = found.select("doc_id", middle.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert {(r.doc_id, r.t) for r in back} == {(r[0], r[1] or "") for r in DOCS}
    for bad in (("<P>", "<P>x", "<M>"), ("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, sentinels=bad)


def test_marks_of_words():
    draw = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 500):
        data = draw.choice(np.array([0x0A, 0x0B, 0x8A, 0x00, 0xFF, 0x41], np.uint8), size)
        words = np.concatenate((data, np.zeros(16 - size % 8, np.uint8))).view("<u8")
        marks, where = middle.Marks(middle.line_ends(words)), np.flatnonzero(data == 0x0A)
        assert marks.select(np.arange(1, len(where) + 1)).tolist() == where.tolist()
        assert marks.rank(np.arange(size + 1)).tolist() == [int((data[:k] == 0x0A).sum()) for k in range(size + 1)]


def failures(rows):
    """(part, set of failed letters, doc_id) of each row."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    for r in rows:
        text, words = r[1] or "", cases.words(r[1])
        own = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and r[0] > least[text],
        }
        yield r[2] or "", {x for x, failed in own.items() if failed}, r[0]


def audited(rows, labels, before=()):
    own, found, shapley = list(failures(rows)), {}, collections.Counter()
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    for part in {p for p, _, _ in own}:
        for order in map("".join, itertools.permutations("ABCDE")):
            if any(order.index(a) > order.index(b) for a, b in before):
                continue
            left = [(f, d) for p, f, d in own if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                out = [r for r in left if x in r[0]]
                redundant = sum(x in r[0] for r in gone)
                left, gone = [r for r in left if x not in r[0]], gone + out
                shapley[part, x] += len(out)
                found[part, order, step] = [len(left), len(out), redundant, sum(f == {x} for p, f, _ in own if p == part), sum(d in good for _, d in out), sum(d in toxic for _, d in out)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


@pytest.mark.parametrize("before", [(), (("E", "A"), ("C", "D"))])
def test_filter_audit(spark, docs, before):
    labels = [(3, 1, 0), (3, None, 1), (305, 1, None), (307, 1, 1), (408, 0, 1), (409, 1, 1), (None, 1, 1), (999, 1, 1), (301, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    found = filter_audit.filter_audit(docs, table, before=before)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == audited(DOCS, labels, before) and len(rows) == len(set(rows))


def test_paths_count_orders():
    for names, before in (("ABC", ()), ("ABCDE", (("A", "B"), ("B", "C"))), ("ABCD", (("D", "A"),))):
        paths = collections.Counter((s, f) for _, _, s, f in filter_audit.orders(names, before))
        assert {(s, f): p for s, f, p in filter_audit.edges(names, before)} == dict(paths)
    with pytest.raises(ValueError):
        filter_audit.edges("ABCDEFGHI")


def tree(rows, first, k, out):
    """The tree over (codes, tie, size, key) rows in plain Python."""
    if k == 1 or not rows:
        out |= {r[3]: first for r in rows}
        return
    widths = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(len(rows[0][0]))]
    dim = widths.index(max(widths))
    goal, below = sum(r[2] for r in rows) * (k // 2 / k), 0
    for code in sorted({r[0][dim] for r in rows}):
        here = sum(r[2] for r in rows if r[0][dim] == code)
        if below + here >= goal:
            break
        below += here
    at = [r for r in rows if r[0][dim] == code]
    borders = {b for r in at for b in (r[1], r[1] + 1)}
    border = min(borders, key=lambda b: (abs(below + sum(r[2] for r in at if r[1] < b) - goal), b))
    left = [r for r in rows if (r[0][dim], r[1]) < (code, border)]
    tree(left, first, k // 2, out)
    tree([r for r in rows if (r[0][dim], r[1]) >= (code, border)], first + k // 2, k - k // 2, out)


@pytest.mark.parametrize("shards,dims", [(1, ("source", "lang")), (13, ("n_chars", "source")), (5, ())])
def test_shards(spark, docs, shards, dims):
    rows, _, _, n = sharding._grown(docs, shards, None, dims)
    rows = rows.collect()
    wanted = {}
    tree([(tuple(r.codes), r.tie, r.size, r.row) for r in rows], 0, shards, wanted)
    assert n == shards and {r.row: r["first"] for r in rows} == wanted
    found = sharding.kd_shards(docs, shards, dims=dims).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in DOCS), key=str)
    for own in collections.Counter(r.shard for r in found):
        assert sorted(r.slot for r in found if r.shard == own) == list(range(sum(r.shard == own for r in found)))
    assert {r.shard for r in found} <= set(range(shards))


def test_shards_are_near_equal(spark):
    """A hot source, copies of one row, and null ids: every shard is within a few documents of the mean."""
    rows = [(i, "w " * (20 + i % 90), "en", "hot" if i % 3 else f"s{i % 50}") for i in range(3000)] + [(7, "the same row " * 5, "en", "copy")] * 1500 + [(None, f"no id {i}", None, None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sharding.kd_shards(docs, 16).collect()
    bytes_of = collections.Counter()
    for r in found:
        bytes_of[r.shard] += r.size
    mean = sum(bytes_of.values()) / 16
    assert len(found) == len(rows) and len(bytes_of) == 16 and all(abs(b - mean) < 0.05 * mean for b in bytes_of.values())
    by_bytes = sharding.kd_shards(docs, target_bytes=20_000).agg(F.max("shard"), F.count("*")).first()
    assert by_bytes[0] + 1 == -(-sum(bytes_of.values()) // 20_000) and by_bytes[1] == len(rows)
    with pytest.raises(ValueError):
        sharding.kd_shards(docs)


def test_written_shards(spark, docs, tmp_path):
    folder = f"{tmp_path}/shards"
    assert sharding.write_shards(docs, folder, 6) == 6
    back = spark.read.parquet(folder)
    assert sorted((str(r.doc_id), r.text or "") for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in DOCS)
    sizes = lambda df: sorted(tuple(r) for r in df.groupBy("shard").agg(F.count("*"), F.sum("n_chars")).collect())
    told = sharding.kd_shards(docs, 6)
    assert sizes(back.select("shard", "n_chars"))[0][0] == 0 and {r.shard for r in back.select("shard").distinct().collect()} == {r.shard for r in told.select("shard").distinct().collect()}


def test_empty_tables(spark, tmp_path):
    none = cases.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (sharding.kd_shards(none, 40), sharding.kd_shards(none, target_bytes=100), filter_audit.filter_audit(none, labels), middle.fill_in_middle(none)):
        assert found.count() == 0
    assert sharding.write_shards(none, f"{tmp_path}/none", 3) == 3
    assert filter_audit.filter_audit(cases.frame(spark, SHORT), labels).count() > 0


def test_registered_queries(spark, tmp_path):
    """The digests and columns that the queries add to the operators' results."""
    cases.frame(spark, SHORT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = [(*x[:5], sha(x[5]), sha(r[1] or "")) for r in SHORT for x in [cut(r[0], r[1], "line")]]
    assert sorted(map(tuple, queries.op13_middle(spark, str(tmp_path)).collect()), key=str) == sorted(wanted, key=str)
    shards = queries.op11_sharding(spark, str(tmp_path))
    assert shards.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = shards.collect()
    assert len(rows) == len(SHORT) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and {r.shard for r in rows} <= set(range(40))
    assert {tuple(r) for r in queries.op12_filter_audit(spark, str(tmp_path)).collect()} == audited(SHORT, [(3, 1, 0)])
