"""Every operator on awkward documents against plain Python, and on an empty table."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evipack.llm import bloom, bpe, components, exact_dedup, html, licenses, line_dedup, mixing, pii, quality, scratch, simhash, skew, token_counts
from tests.llm import cases

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = cases.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(25)] + [(312, 0, 1), (313, 0, 0), (None, 1, 0), (5, None, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_empty_tables(spark, labels):
    none = cases.empty(spark)
    found = [
        simhash.simhash_near_dedup(none), licenses.license_scan(none), token_counts.token_counts(none, PIECES), quality.quality_rules(none, labels), exact_dedup.exact_dedup(none),
        bpe.bpe_round_trip(none, BPE), pii.pii_spans(none), line_dedup.line_dedup(none), mixing.mix(none), mixing.mixed_documents(none), exact_dedup.keep_first_copies(none),
        simhash.keep_one_of_each(none), quality.keep_good(none, labels.limit(0)),
    ]
    assert [f.count() for f in found] == [0] * len(found)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("bucket", [512])
def test_simhash(docs, bucket):
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(docs, bucket).collect()), key=str)
    prints = [fingerprint(r[1]) for r in DOCS]
    near = {k: {j for j in range(len(DOCS)) if bin(prints[k] ^ prints[j]).count("1") <= 3} for k in range(len(DOCS))}
    group, wanted = {}, []
    for k in range(len(DOCS)):
        if k not in group:
            todo, own = [k], {k}
            while todo:
                fresh = near[todo.pop()] - own
                own |= fresh
                todo += fresh
            group |= dict.fromkeys(own, own)
        ids = [DOCS[j][0] for j in group[k] if DOCS[j][0] is not None]
        wanted.append((DOCS[k][0], f"{prints[k]:016x}", min(ids) if ids else None))
    assert found == sorted(wanted, key=str)


def test_simhash_links_of_small_buckets(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (1 << 40,)], "fp long")
    found = dict(components.connected_components(simhash.near_links(nodes, bucket=1)).collect())
    assert found == {0: 0, 1: 0, 2: 0, 1 << 40: 0}


def test_simhash_links_are_whole(spark):
    """Dense groups: split buckets connect just what all pairs connect."""
    draw = random.Random(3)
    center = draw.getrandbits(64)
    values = {center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(400)} | {draw.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = dict(components.connected_components(simhash.near_links(nodes, bucket=8)).select("node", "root").collect())
    array = np.array(signed, np.int64).view(np.uint64)
    label = {v: v for v in signed}
    for _ in range(50):
        for k, v in enumerate(signed):
            close = np.flatnonzero(np.bitwise_count(array ^ array[k]) <= 3)
            least = min(label[signed[j]] for j in close)
            for j in close:
                label[signed[j]] = least
    groups = collections.defaultdict(set)
    for v in signed:
        groups[label[v]].add(v)
    for own in groups.values():
        assert len({found.get(v, v) for v in own}) == 1
    assert len({found.get(v, v) for v in signed}) == len(groups)


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_long_path(spark, shuffled):
    path = list(range(300))
    if shuffled:
        random.Random(1).shuffle(path)
    links = spark.createDataFrame([*zip(path, path[1:]), (500, 501), (7, 7)], "a long, b long")
    found = dict(components.connected_components(links).collect())
    assert all(found[v] == 0 for v in path) and found[500] == found[501] == 500


def test_exact_dedup(docs):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in DOCS:
        groups[key(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    wanted = []
    for r in DOCS:
        own = groups[key(r[1])]
        keep = min(own)[3]
        wanted.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(key(r[1]).encode()).hexdigest()))
    found = [tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in wanted if w[3])


def test_dedup_drops_no_other_text(spark):
    """Ids that repeat or are null name rows only together with their text."""
    texts = ["one text of five words", "another text of many other words", "this text is unique among these rows", "so is that text, in its own way"]
    rows = [(5, texts[0]), (None, texts[0]), (None, texts[2]), (3, texts[1]), (7, texts[1]), (7, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted([(5, texts[0]), (None, texts[2]), (3, texts[1]), (7, texts[3])], key=str)
    for keep in (exact_dedup.keep_first_copies, simhash.keep_one_of_each):
        assert sorted(map(tuple, keep(df).collect()), key=str) == wanted


@pytest.mark.parametrize("range_hashes", [16, 1 << 24])
def test_filters_by_ranges(spark, docs, range_hashes):
    """Many small ranges give what one gives, and rows that no filter knows pass without an exchange."""
    s = bloom.shape_for(1000, range_hashes)
    assert s.ranges * range_hashes >= 1000 and s.words <= max(bloom.BLOCK, range_hashes * bloom.BITS_PER_HASH // 64)
    draw = random.Random(11)
    values = [draw.getrandbits(64) - (1 << 63) for _ in range(900)]
    rows = scratch.written(spark.createDataFrame([(v,) for v in values + values[:50]], "h long").sortWithinPartitions("h"), "test-hashes")
    marked = bloom.marked(rows, "test", range_hashes)
    suspects = collections.Counter(r.h for r in marked.where("suspect").collect())
    assert marked.count() == 950 and all(suspects[v] == 2 for v in values[:50]) and sum(suspects.values()) < 200
    found, whole = (sorted(map(str, exact_dedup.exact_dedup(docs, r).collect())) for r in (range_hashes, 1 << 24))
    assert found == whole
    keys = scratch.written(spark.createDataFrame([(v,) for v in values[:100]], "h long"), "test-keys")
    tried = bloom.may_hold(rows, keys, "test", range_hashes)
    hits = {r.h for r in tried.where("suspect").collect()}
    assert hits >= set(values[:100])
    assert "Exchange hashpartitioning" not in tried._jdf.queryExecution().executedPlan().toString()


def test_joins_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 8)
    keys = [0] * 60 + [1] * 40 + list(range(2, 30)) + [None]
    rows = scratch.written(spark.createDataFrame([(k, i, k is not None and k < 25) for i, k in enumerate(keys)], "key long, i long, suspect boolean"), "test-rows")
    groups = scratch.written(spark.createDataFrame([(k, keys.count(k), f"g{k}") for k in range(25)], "key long, n long, name string"), "test-groups")
    wanted = sorted((i, f"g{k}" if k is not None and k < 25 else None) for i, k in enumerate(keys))
    left = skew.join_groups(rows, groups, "key", "n", "left")
    assert sorted((r.i, r.name) for r in left.collect()) == wanted
    assert sorted((r.i, r.name) for r in skew.join_groups(rows, groups, "key", "n").collect()) == [x for x in wanted if x[1]]
    assert sorted((r.i, r.name) for r in skew.join_suspects(rows, groups, "key", "n").collect()) == wanted


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.token_counts(docs, PIECES, batch_bytes=500, piece_chars=64).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    wanted = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in DOCS]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_token_pieces_add_up():
    import sentencepiece

    model, draw = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    for _ in range(500):
        text = "".join(draw.choice("ab  é▁\n.世") for _ in range(draw.randint(0, 80)))
        assert sum(len(model.encode(p)) for p in token_counts.safe_pieces(text, 10)) == len(model.encode(text))


def test_quality(docs, labels):
    found = quality.quality_rules(docs, labels).collect()
    wanted = []
    for i, text, *_ in DOCS:
        own = cases.words(text)
        lines = (text or "").split("\n")
        dup = sum(bool(cases.words(x)) and x in lines[:k] for k, x in enumerate(lines))
        at = collections.defaultdict(list)
        for k in range(len(own) - 2):
            at[tuple(own[k : k + 3])].append(k)
        repeat = len({k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(3)})
        wanted.append((i, len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, len(own) < 50 or 100 * repeat > 50 * len(own)))
    assert sorted(str(tuple(r)[:7]) for r in found) == sorted(map(str, wanted))
    kept = {r.doc_id: r.kept for r in found}
    assert not any(r.kept and r.base_failed for r in found)
    assert all(kept[i] for i in range(25)) and not kept[312] and not kept[313] and not kept[300]
    again = quality.quality_rules(docs, labels).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    good = sorted(str(r.doc_id) for r in quality.keep_good(docs, labels).collect())
    assert good == sorted(str(r.doc_id) for r in found if r.kept)


def test_quality_without_labels_uses_the_base_rules(docs, labels):
    found = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in found)


def test_quality_fits_repeated_rows_once(spark, docs, labels):
    stats = quality.rule_statistics(docs).where("doc_id < 25")
    once, twice = (quality.fit(rows, quality.chosen_labels(labels)) for rows in (stats, stats.unionByName(stats)))
    assert once[1] == twice[1] and all(np.array_equal(a, b) for s, t in zip(once[0].trees, twice[0].trees, strict=True) for a, b in zip(s, t, strict=True))
    assert quality.chosen_labels(labels, 4).count() == 4


def test_quality_isolates_by_every_statistic(spark):
    """Odd word lengths, repeated lines and repeated words below the base limit are rejected without a labelled example."""
    draw = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(draw.choice(list("etaoinshrdlu"), draw.integers(2, 9))) for _ in range(n))
    lines = lambda n: "\n".join(prose(10) for _ in range(n // 10))
    good = [(k, lines(int(draw.integers(80, 600)))) for k in range(400)]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    bad = [
        (1000, " ".join("".join(draw.choice(letters, 300)) for _ in range(100))), (1001, " ".join(draw.choice(letters, 300))),
        (1002, prose(165) + "\nread on here now" * 33), (1003, prose(200) + "\nmore" * 80),
    ]
    labels = spark.createDataFrame([(k, 1) for k in range(300)], "doc_id long, quality long")
    found = quality.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string"), labels).collect()
    kept = {r.doc_id: r.kept for r in found if not r.base_failed}
    assert not any(kept[k] for k in (1000, 1001, 1002)) and sum(kept[k] for k in range(300, 400)) >= 95


def test_forest_on_held_out_rows():
    draw = np.random.default_rng(0)
    good = np.column_stack([np.zeros(2000), np.zeros(2000), draw.beta(2, 80, 2000)])
    bad = np.column_stack([draw.uniform(0.3, 3, 200), np.zeros(200), draw.beta(2, 80, 200)])
    forest = quality.IsolationForest(good[:1000], np.vstack([good[:1000], bad[:100]]))
    limit = quality.threshold(forest.score(np.vstack([good[:1000], bad[:100]])), np.repeat([1, 0], [1000, 100]))
    assert (forest.score(good[1000:]) > limit).mean() < 0.01
    assert (forest.score(bad[100:]) > limit).mean() > 0.9


def test_forest_path_lengths():
    """Scores against a walk down each tree; the threshold against a count at every cut."""
    draw = np.random.default_rng(1)
    points = draw.normal(size=(60, 3))
    forest = quality.IsolationForest(points, np.array([[-4.0] * 3, [4.0] * 3]), trees=20, rows=32)

    def usual(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(tree, x):
        feature, cut, left, path = tree
        at, depth = 0, 0
        while feature[at] >= 0:
            at, depth = left[at] + (x[feature[at]] >= cut[at]), depth + 1
        assert path[at] >= depth
        return path[at]

    wanted = [2 ** (-np.mean([walk(tree, x) for tree in forest.trees]) / usual(32)) for x in points]
    assert np.allclose(forest.score(points), wanted)
    kinds = draw.integers(0, 2, 60)
    scores = np.round(draw.random(60), 1)
    cost = lambda c: round(np.mean(scores[kinds == 0] <= c) + 3 * np.mean(scores[kinds == 1] > c), 12)
    assert quality.threshold(scores, kinds, 3) == min(np.unique(scores), key=lambda c: (cost(c), c))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the labelled table")
def test_quality_on_held_out_labels(spark):
    """Fitted on one half of the labelled rows, tried on the other, both ways, over all that the base rules pass."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.rule_statistics(docs).where(~quality.base_failed()).join(labels.select("doc_id", "quality"), "doc_id").toPandas().sort_values("doc_id")
    points, kinds, half = quality.features(rows), rows["quality"].to_numpy(), (rows["doc_id"] % 2).to_numpy()
    caught = lost = 0
    for k in (0, 1):
        own = half == k
        forest = quality.IsolationForest(points[own & (kinds == 1)], np.vstack([points[own], quality.BOX]))
        over = forest.score(points[~own]) > quality.threshold(forest.score(points[own]), kinds[own])
        caught, lost = caught + (over & (kinds[~own] == 0)).sum(), lost + (over & (kinds[~own] == 1)).sum()
    print(f"caught {caught} of {(kinds == 0).sum()}, lost {lost} of {(kinds == 1).sum()}")
    assert caught >= 0.95 * (kinds == 0).sum() and lost <= 0.01 * (kinds == 1).sum()


def test_bpe(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    for options in ({}, {"block_chars": 5000, "buckets": 7}):
        found = [(r.doc_id, list(r.ids), r.decoded) for r in bpe.bpe_round_trip(docs, BPE, **options).collect()]
        wanted = [(i, ids := own.encode(t or "", add_special_tokens=False).ids, own.decode(ids, skip_special_tokens=False)) for i, t, *_ in DOCS]
        assert sorted(found, key=str) == sorted(wanted, key=str)


def test_bpe_splits_as_the_library():
    own = bpe._tokenizer(BPE)
    split, draw = bpe.splitter(own), random.Random(2)
    signs = "aZ  \t\n'sé1²½  Ω՘Ᲊ漢🙂_-."
    for _ in range(2000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 20)))
        assert split(text) == [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)]


def spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii(spark, docs):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab@.1234 +-()é\n") for _ in range(draw.randint(0, 120))) for _ in range(300)]
    texts += ["007.1.1.0255 1.1.1.256", "a@b.c_d@e.f", "+1+1" * 50, "4111-1111-1111-1112 4111-1111-1111-1111", "1." * 3000, "1 " * 6000]
    rows = [(k, t) for k, t in enumerate(texts)]
    for df, texts in ((docs.where("doc_id <> 309"), [(r[0], r[1]) for r in DOCS if r[0] not in (309, None)]), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        found = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]) for r in pii.pii_spans(df).collect())
        assert found == sorted((i, spans(t or "")) for i, t in texts)


def test_pii_added_kinds(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 no"), (3, "call 743 555 3824"), (4, "order 743 555 3824"), (5, "my SSN 078-05-1120"), (6, "phone +1 743 555 3824")]
    rows += [(7, "IBAN DE89 3704 0044 0532 0130 00 PLEASE PAY"), (8, "DE89370400440532013000 BIC COBADEFFXXX"), (9, "743 555 3824 is my phone"), (10, "phone 212-555-0100, 212-555-0101, 212-555-0102"), (11, "078-05-1120 " * 3000)]
    found = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: [("iban", "DE89 3704 0044 0532 0130 00")], 2: [], 3: [("national_phone", "743 555 3824")], 4: [], 5: [("national_id", "078-05-1120")], 6: [("phone", "+1 743 555 3824")]} | {
        7: [("iban", "DE89 3704 0044 0532 0130 00")], 8: [("iban", "DE89370400440532013000")], 9: [("national_phone", "743 555 3824")],
        10: [("national_phone", f"212-555-010{k}") for k in range(3)], 11: [],
    }


def test_line_dedup(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(cases.BLANK))
    held = collections.defaultdict(list)
    for i, text, *_ in DOCS:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= 5}
    wanted = []
    for i, text, *_ in DOCS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        wanted.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    found = [tuple(r) for r in line_dedup.line_dedup(docs).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert sum(w[3] for w in wanted) > 5


def test_line_dedup_counts_documents(spark):
    """Five rows of two documents lose nothing; rows without an id count as one document."""
    line = "a line that is long enough to be counted by its documents"
    few = spark.createDataFrame([(1 + k % 2, f"{line}\nown {k}") for k in range(5)], "doc_id long, text string")
    assert line_dedup.line_dedup(few).agg(F.sum("n_dropped")).first()[0] == 0
    rows = [(k, f"{line}\n{k}") for k in (1, 2, 3, 4)] + [(None, f"{line.upper()} \nnone {k}") for k in range(3)] + [(4, line)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in found) == sorted((str(i), int(i != 4)) for i, _ in rows)


@pytest.mark.parametrize("shard_words", [1 << 19, 500])
def test_mixing(docs, shard_words):
    found = mixing.mix(docs, block_words=shard_words, shard_blocks=5).collect()
    assert sorted(str((r.doc_id, r["size"])) for r in found) == sorted(str((i, len(cases.words(t)))) for i, t, *_ in DOCS)
    held = collections.Counter()
    for i, t, _, source, _ in DOCS:
        held[source] += len(cases.words(t))
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, 1.5 * sum(held.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * held[s]]
        if not over:
            break
        fixed |= {s: 2.0 * held[s] for s in over}
    taken = collections.Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == held[r.source]
        assert r.target == pytest.approx(fixed.get(r.source, weight[r.source] * level))
        taken[r.source] += r.taken
    assert all(abs(taken[s] - fixed.get(s, weight[s] * level)) <= 0.5 for s in order)
    again = mixing.mix(docs.repartition(5), block_words=shard_words, shard_blocks=5).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, again)))


def test_mixing_draws_are_hypergeometric(spark):
    rows = spark.range(4000).select(F.lit(30).cast("long").alias("white"), F.lit(50).cast("long").alias("black"), F.lit(20).cast("long").alias("take"), "id")
    drawn = np.array([r[0] for r in rows.select(mixing._drawn(F.col("white"), F.col("black"), F.col("take"), F.col("id"))).collect()])
    assert 0 <= drawn.min() and drawn.max() <= 20
    assert abs(drawn.mean() - 7.5) < 0.15 and abs(drawn.var() - 20 * (30 / 80) * (50 / 80) * (60 / 79)) < 0.4


def test_mixing_draws_of_any_size(spark):
    """Sources of up to 10^13 words are split without overflow, near their mean."""
    for n in (10**6, 5 * 10**9, 10**13):
        rows = spark.range(50).select(F.lit(n).alias("white"), F.lit(2 * n).alias("black"), F.lit(n).alias("take"), "id")
        drawn = [r[0] for r in rows.select(mixing._drawn(F.col("white"), F.col("black"), F.col("take"), F.col("id"))).collect()]
        assert all(0 <= x <= n for x in drawn) and len(set(drawn)) > 20 and all(abs(x - n / 3) < 8 * (n * 4 / 27) ** 0.5 for x in drawn)


def test_mixing_spreads_rows_without_words(spark):
    rows = [(k, "" if k % 50 else "five words are in here", "s") for k in range(1000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=100).collect()
    shards = collections.Counter(r.block for r in found)
    assert len(shards) == 10 and max(shards.values()) < 200
    assert sum(r.taken for r in found) == 150 and all(r.taken <= 2 * r["size"] for r in found)


def test_mixed_documents(docs):
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs).collect() if r.doc_id != 307}
    found = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect() if r.doc_id != 307)
    for i, (t, n) in taken.items():
        assert found[i] == (int(t / n + 0.5) if n else 0)
    small = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs, block_words=500, block_rows=20).collect() if r.doc_id != 307}
    found = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs, block_words=500, block_rows=20).collect() if r.doc_id != 307)
    assert {i: found[i] for i in small} == {i: int(t / n + 0.5) if n else 0 for i, (t, n) in small.items()}


def test_mixing_shards_share_all_sources(spark, docs):
    """Shards are disjoint, add up to the quotas, are alike in size, and each holds every source near its share of the mix."""
    rows = [(k, " ".join(["w"] * (5 + k % 11)), f"s{min(k % 7, 3)}") for k in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"shard": F.lit("clash"), "place": F.lit("clash")})
    found = mixing.mixed_shards(table, block_words=60, shard_blocks=120, columns=("at shard", "at place"))
    got = found.select("doc_id", "source", "at shard", "at place", "shard").collect()
    held, words = collections.defaultdict(collections.Counter), {k: len(t.split()) for k, t, _ in rows}
    for r in got:
        held[r["at shard"]][r.source] += words[r.doc_id]
    mixed = mixing.mix(table, block_words=60, shard_blocks=120).collect()
    target = {r.source: r.target for r in mixed}
    everything = sum(target.values())
    assert sorted(held) == list(range(len(held))) and len(held) > 8 and {r["shard"] for r in got} == {"clash"}
    for own in held.values():
        assert abs(sum(own.values()) / (everything / len(held)) - 1) < 0.25
        assert all(abs(own[s] / sum(own.values()) - t / everything) < 0.12 for s, t in target.items())
    assert len({(r.doc_id, r["at shard"], r["at place"]) for r in got}) == len(got)
    shards = {r.doc_id: r.shards for r in mixed}
    assert all(r["at shard"] in shards[r.doc_id] for r in got) and all(len(r.shards) <= 2 for r in mixed)
    again = mixing.mixed_shards(table.repartition(7), block_words=60, shard_blocks=120, columns=("at shard", "at place")).select("doc_id", "at shard", "at place").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r["at shard"], r["at place"]) for r in got)


def test_mixing_tree_is_multivariate_hypergeometric(spark):
    """Quotas of three sources over four shards, many times: sums are exact, means and spreads as of a permuted deal."""
    quotas = [30, 50, 20]
    seen = []
    nodes = spark.range(2500).select((F.col("id") * 4).alias("first"), F.lit(4).cast("long").alias("k"), F.array(*[F.lit(q).cast("long") for q in quotas]).alias("quotas"))
    for level in range(2):
        nodes = mixing._split(nodes, level, 1)
    trees = collections.defaultdict(list)
    for r in nodes.collect():
        assert r.k == 1 and sum(r.quotas) == 25
        trees[r["first"] // 4].append(r.quotas)
        seen.append(r.quotas)
    assert all(len(t) == 4 and [sum(x) for x in zip(*t, strict=True)] == quotas for t in trees.values())
    seen = np.array(seen)
    for k, q in enumerate(quotas):
        assert abs(seen[:, k].mean() - q / 4) < 1e-9 and abs(seen[:, k].var() - 25 * q / 100 * (1 - q / 100) * 75 / 99) < 0.25
    assert abs(np.cov(seen[:, 0], seen[:, 1])[0, 1] + 25 * 0.3 * 0.5 * 75 / 99) < 0.25


def test_licenses(docs, spark):
    found = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    assert found == {(310, "CC-BY-NC-4.0")}
    rows = [(k, f"Some words before.\n{t}\nand after") for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(100, None), (101, "MIT"), (102, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.")]
    got = {(r.doc_id, r.license, r.dice) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, n, 1.0) for k, (n, _) in enumerate(licenses.TEMPLATES)} | {(102, "Apache-2.0", 1.0)} <= got and not any(k in (100, 101) for k, _, _ in got)


def test_licenses_wrapped_in_comments(spark):
    """Every template at the head of a file, wrapped at 72 columns with comment signs and a changed word or two."""
    draw, rows = random.Random(9), []
    code = " ".join(f"name{draw.randint(0, 300)} = value{draw.randint(0, 300)};" for _ in range(300))
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 40:
            words[10] = "changed"
        lines, line = [], ""
        for w in words:
            line, lines = (f"{line} {w}", lines) if len(line) + len(w) < 72 else (w, [*lines, line])
        rows.append((k, "/*\n" + "\n".join(f" * {x}" for x in [*lines, line]) + "\n */\n" + code))
    got = {(r.doc_id, r.license) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, n) for k, (n, _) in enumerate(licenses.TEMPLATES)}


def test_licenses_lose_no_window():
    """Postings and bounds give just the windows that a comparison at every place gives."""
    known, draw = licenses.Templates(), random.Random(10)
    for _ in range(60):
        words = []
        for _ in range(draw.randint(1, 4)):
            own = draw.choice(licenses.NOTICES)[1].split()
            words += [w for w in own if draw.random() > 0.04] + draw.choices(["the", "license", "under", "of", "other"], k=draw.randint(0, 8))
        text, wanted = " ".join(words), set()
        own = licenses.words_of(text)
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            grams, n = licenses.bigrams(licenses.words_of(template)), len(licenses.words_of(template))
            for start in range(len(own) - 1):
                if (own[start], own[start + 1]) in grams:
                    window = licenses.bigrams(own[start : start + n])
                    d = 2 * len(window & grams) / (len(window) + len(grams))
                    if d >= licenses.MIN_DICE - 1e-12:
                        wanted.add((d, n, start, k))
        assert set(known.windows(text)) == wanted
        better = lambda x, y: (y[0], y[1], -y[2]) > (x[0], x[1], -x[2]) and y[2] < x[2] + x[1] and y[2] + y[1] > x[2]
        assert set(known.matches(text)) == {x for x in wanted if not any(better(x, y) for y in wanted)}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div id="cookie-notice">We use cookies</div><nav><a>x</a></nav>
<%s><h1>Title &amp; more</h1><p>One<br>two   three <a href=x>link</a>.<p>Next <b>bold<ul><li>a<li>b</ul><form><input><button>Go</button></form><div class="comments"><p>nice</p></div>
<aside>side</aside><blockquote>q</blockquote></%s><div class="ad">buy</div><script>var t="</p>";</script><footer>f</footer></body>"""


def test_html(spark):
    text = "Title & more\n\nOne two three link.\n\nNext bold\n\na\n\nb\n\nq"
    rows = [(1, "http://a.example/1", PAGE % ("article", "article")), (2, "http://a.example/2", None), (3, None, ""), (4, "http://b.example/1", PAGE % ("div", "div")), (5, "x", "plain <b>text"), (5, "x", "plain <b>text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in cases.CLASHING})
    found = sorted((r.page_id, r.text) for r in html.main_text(pages).collect())
    assert found == [(1, text), (2, ""), (3, ""), (4, text), (5, "plain text"), (5, "plain text")]


def test_html_wrapper_of_a_host(spark):
    """Without an article element, what a host repeats is template and what varies is content."""
    body = "<body><div><p>Welcome to our site</p></div><div><p>Story number {k} tells of {k} things</p>{more}</div><div><p>All rights reserved</p></div></body>"
    rows = [(k, f"https://h.example/{k}", body.format(k=k, more="<ul><li>extra</li></ul>" if k % 3 == 0 else "")) for k in range(9)]
    found = dict(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert found == {k: f"Story number {k} tells of {k} things" + ("\n\nextra" if k % 3 == 0 else "") for k in range(9)}


def test_html_wrapper_inside_articles(spark):
    """Repeats below an article are template too, unless whole articles are copied, with or without changes."""
    page = "<body><article><h1>Story {k}</h1><p>It tells of {k} things and of {k} more</p><p>Read our other stories</p></article></body>"
    rows = [(k, f"https://i.example/{k}", page.format(k=k)) for k in range(9)]
    whole = "<body><p>{k}</p>{x}<main><p>A copied story with many words that all of its copies have</p><p>and an end</p>{y}</main></body>"
    copies = [(k, f"https://j.example/{k}", whole.format(k=k, x="<ul><li>x</li></ul>" * (k % 3), y="")) for k in range(20, 29)]
    changed = [(k, f"https://k.example/{k}", whole.format(k=k, x="", y=f"<p>{k}</p>")) for k in range(30, 39)]
    found = dict(html.main_text(spark.createDataFrame(rows + copies + changed, "page_id long, url string, html string")).select("page_id", "text").collect())
    story = "A copied story with many words that all of its copies have\n\nand an end"
    assert found == {k: f"Story {k}\n\nIt tells of {k} things and of {k} more" for k in range(9)} | {k: story for k in range(20, 29)} | {k: f"{story}\n\n{k}" for k in range(30, 39)}


def test_tree_matching():
    tree = lambda *nodes: html.read_tree("/".join(("-1:", *nodes)))
    a, b = tree("0:body", "1:div", "1:p", "1:ul", "4:li"), tree("0:body", "1:p", "1:ul", "3:li", "1:div")
    size, pairs = html.simple_tree_matching(a, b)
    assert size == 5 and (5, 4) in pairs and len(pairs) == 5

    def recursive(x, y):  # the textbook form
        if a[0][x] != b[0][y]:
            return 0
        best = [[0] * (len(b[2][y]) + 1) for _ in range(len(a[2][x]) + 1)]
        for i, u in enumerate(a[2][x]):
            for j, v in enumerate(b[2][y]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + recursive(u, v))
        return best[-1][-1] + 1

    draw = random.Random(6)
    for _ in range(100):
        a, b = (tree(*[f"{draw.randint(0, k)}:{draw.choice('xyz')}" for k in range(draw.randint(1, 12))]) for _ in range(2))
        size, pairs = html.simple_tree_matching(a, b)
        assert size == recursive(0, 0) == len(pairs) and all(a[0][x] == b[0][y] for x, y in pairs)


def test_html_deep_and_long_pages(spark):
    deep = "<div>" * 1500 + "deep down {k} and more of {k}" + "</div>" * 1500
    rows = [(k, f"https://d.example/{k}", deep.format(k=k)) for k in range(6)] + [(9, "https://e.example/", "<p>" + "long " * 200_000)]
    found = dict(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert found == {k: f"deep down {k} and more of {k}" for k in range(6)} | {9: ("long " * 200_000).strip()}


def test_html_slots_decide(spark):
    """Rotating adverts, menus and footers without any role, in two layouts of one host, against a count over all its pages."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    ads, menus = [" ".join(word() for _ in range(6)) for _ in range(4)], [word() for _ in range(5)]
    rows, wanted = [], {}
    for k in range(60):
        body = [" ".join(word() for _ in range(12)) for _ in range(draw.randint(1, 4))]
        wanted[k] = "\n\n".join(body)
        content = "".join(f"<p>{x}</p>" for x in body)
        menu = "".join(f"<li>{draw.choice(menus)}</li>" for _ in range(3))
        layout = f"<ul>{menu}</ul><section>{content}</section><div>{draw.choice(ads)}</div>" if k % 3 else f"<table><tr><td>{content}</td></tr></table><ol>{menu}</ol><h6>{draw.choice(ads)}</h6>"
        rows.append((k, f"https://two.example/{k}", f"<body>{layout}</body>"))
    found = dict(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert found == wanted

    # The same by plain counting: a block's place is its chain of tags.
    pages = {k: (html.blocks(html.parse(page)), k) for k, _, page in rows}
    seen = collections.defaultdict(list)
    for (tree, own), k in pages.values():
        for node, _, text, _ in own:
            seen[tree[node][2]].append((k, text))
    constant, fresh = set(), {}
    for path, held in seen.items():
        held, here = set(held), len({k for k, _ in held})
        n = collections.Counter(t for _, t in held)
        constant |= {(path, t) for t in n if n[t] >= 0.5 * here}
        rest = {t: c for t, c in n.items() if c < 0.5 * here}
        fresh[path] = len(rest) / max(1, sum(rest.values()))
    plain = {k: "\n\n".join(t for node, _, t, _ in own if fresh[tree[node][2]] >= 0.5 and (tree[node][2], t) not in constant) for (tree, own), k in pages.values()}
    assert found == plain


def test_html_small_hosts_keep_shared_paragraphs(spark):
    """Four or seven articles of which half share a headline and a paragraph, and a passage that articles of many hosts quote."""
    page = "<body><nav>menu</nav><article><h1>{h}</h1><p>{p}</p><p>Own words {k} of page {k}</p></article></body>"
    rows, wanted = [], {}
    for host, n in (("s", 4), ("t", 7), ("u", 30)):
        for k in range(n):
            title, quote = ("The same headline", "A passage that others quote") if k % 2 else (f"Headline {host} {k}", f"Words of {host} {k} alone")
            rows.append((len(rows), f"https://{host}.example/{k}", page.format(h=title, p=quote, k=f"{host}{k}")))
            wanted[len(rows) - 1] = f"{title}\n\n{quote}\n\nOwn words {host}{k} of page {host}{k}"
    found = dict(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert found == wanted


def test_html_wrapper_without_tags(spark):
    """The given pages with every telling tag, class and role made plain: the wrapper alone finds the articles, and an empty wrapper does not."""
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no table of that size")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    plain = lambda page: re.sub(r"\s(class|id|role)=(\"[^\"]*\"|\S+?(?=[\s>]))", "", re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page or "", flags=re.I))
    articles = {r.page_id: "\n\n".join(x[2] for x in html.blocks(html.parse(r.html or ""))[1] if x[1] == 1) for r in rows}
    bare = [(r.page_id, r.url, plain(r.html)) for r in rows]
    found = dict(html.main_text(spark.createDataFrame(bare, "page_id long, url string, html string").repartition(4)).select("page_id", "text").collect())
    assert sum(found[k] == t for k, t in articles.items()) > 0.98 * len(rows)
    assert all(set(t.split("\n\n")) <= set(found[k].split("\n\n")) for k, t in articles.items())  # nothing of an article is lost
    empty = {k: "\n\n".join(html.content(own, tree, {})) for k, _, page in bare for tree, own in [html.blocks(html.parse(page))]}
    assert sum(empty[k] == t for k, t in articles.items()) < 0.02 * len(rows)


def test_texts_of_a_block_come_in_batches(monkeypatch):
    """A block gives its rows a packed row at a time, so that no task holds its ids and texts at once."""
    monkeypatch.setattr(bpe, "ROW_CHARS", 40)
    texts = [f"word {k} of a text" for k in range(30)] + ["", "word"]
    at, find = {}, bpe.splitter(bpe._tokenizer(BPE))
    found = [np.array([at.setdefault(w, len(at)) for w in find(t)], np.int32) for t in texts]
    rows = list(bpe._packed(0, at, list(range(len(texts))), found, 4))
    words = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows if r[1] >= 0], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (3, pa.binary()), (4, pa.binary()))], ["home", "bucket", "head", "body"])
    packed = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows if r[1] < 0], t) for k, t in ((2, pa.list_(pa.int64())), (3, pa.binary()), (4, pa.binary()))], ["doc_ids", "head", "body"])]
    for coded in bpe._encoded(BPE)([words]):
        packed.append(pa.RecordBatch.from_arrays([pa.nulls(coded.num_rows, pa.list_(pa.int64())), coded["head"], coded["body"]], ["doc_ids", "head", "body"]))
    batches = bpe._assembled(bpe.pieces(BPE))(iter(packed))
    first = next(batches)
    assert first.num_rows < 10
    got = {d: t for b in (first, *batches) for d, t in zip(b["doc_id"].to_pylist(), b["decoded"].to_pylist(), strict=True)}
    assert got == dict(enumerate(texts))


def test_bpe_splits_texts_once(docs, capsys):
    """Words and packed texts come from one exchange: the texts are read, split and dealt once."""
    found = bpe.bpe_round_trip(docs, BPE)
    found.collect()
    found.explain()
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert final.count("MapInArrow run(doc_id") == 1 and "ENSURE_REQUIREMENTS" not in final


def test_bpe_block_is_not_held_twice():
    """A packed block costs less than its own lists again: they are emptied on the way."""
    import tracemalloc

    n = bpe.ROW_CHARS * 4
    found, at = [np.arange(k, k + 4096, dtype=np.int32) % 1000 for k in range(0, n, 4096)], {f"w{k}": k for k in range(1000)}
    tracemalloc.start()
    rows = [(r[0], r[1], r[2]) for r in bpe._packed(0, at, list(range(len(found))), found, 4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n and [k for r in rows if r[1] < 0 for k in r[2]] == list(range(n // 4096))


def test_texts_of_the_mix_move_once(spark):
    """The draws go to the texts, however many they are, so that only the deal to shards shuffles texts; packs have gaps and several draws."""
    table = spark.createDataFrame([(i, f"w{i} " * (i % 90), "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mixing.mixed_shards(table, block_words=200, block_rows=20, shard_blocks=50)
        assert "BroadcastHashJoin [goal number" in found._jdf.queryExecution().executedPlan().toString()
        ours = collections.Counter((r.doc_id, r.shard) for r in found.select("doc_id", "shard").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = mixing.mix(table, block_words=200, block_rows=20, shard_blocks=50).where("taken > 0").collect()
    rows = [r for r in rows if r.taken % r.size == 0]
    assert len(rows) > 1500 and all(ours[r.doc_id, s] == n for r in rows for s, n in collections.Counter(r.shards).items())
