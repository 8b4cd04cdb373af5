"""The registered queries themselves, digests included, against plain Python over the awkward documents."""

import collections
import hashlib
import re

import public_tokenizers
import pytest

from evipack.llm import queries
from tests.llm import cases

DOCS = cases.documents()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    cases.frame(spark, DOCS).write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "https://a.example/1", "<body><nav>x</nav><article><h1>Head</h1><p>É t</p></article></body>"), (2, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def same(found, wanted):
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(wanted, key=str)


def test_op3(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = []
    for r in DOCS:
        n = len(model.encode(r[1] or ""))
        wanted.append((r[0], len((r[1] or "").encode()), n, n > 4096))
    same(queries.op3_token_counts(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit"), wanted)


def test_op5(spark, sf_dir):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in DOCS:
        groups[bare(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    wanted = [(r[0], min(g)[3], len(g), r[0] == min(g)[3], sha(bare(r[1]))) for r in DOCS for g in [groups[bare(r[1])]]]
    same(queries.op5_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), wanted)


def test_op6(spark, sf_dir):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.no_truncation(), model.no_padding()
    wanted = []
    for r in DOCS:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids
        wanted.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False))))
    same(queries.op6_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), wanted)


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_spans(text):
    only = lambda m: re.sub(r"[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, rule, good in rules for m in re.finditer(rule, text or "") if good(m)]


def test_op8(spark, sf_dir):
    found = {}
    for r in queries.op8_pii(spark, sf_dir).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(DOCS)
    for doc in DOCS:
        own = base_spans(doc[1])
        counts = tuple(sum(k == kind for k, _, _ in own) for kind in ("email", "ip", "card", "phone"))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        for r in found[doc[0]]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*counts, sha(told))
            assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(r.spans.split(",")) | {""}
    assert sum(len(base_spans(d[1])) for d in DOCS) >= 4


def test_op9(spark, sf_dir):
    strip = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(cases.BLANK))
    holders = collections.defaultdict(set)
    for r in DOCS:
        for line in (r[1] or "").split("\n"):
            holders[strip(line)].add(r[0])
    wanted = []
    for r in DOCS:
        lines = (r[1] or "").split("\n")
        lost = lambda line: len(strip(line)) >= 40 and len(holders[strip(line)] - {None}) >= 5 and r[0] != max(holders[strip(line)] - {None})  # noqa: B023, E731
        kept = [line for line in lines if not lost(line)]
        wanted.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    same(queries.op9_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256"), wanted)


def test_op10(spark, sf_dir):
    rows = queries.op10_mixing(spark, sf_dir).collect()
    size = {r[0]: len(cases.words(r[1])) for r in DOCS}
    assert len(rows) == len(DOCS) and all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and (len(r.shards) > 0) == (r.taken > 0) for r in rows)
    assert sum({r.target for r in rows}) == pytest.approx(1.5 * sum(len(cases.words(r[1])) for r in DOCS), rel=1e-6)


def test_op7(spark, sf_dir):
    same(queries.op7_html(spark, sf_dir).select("page_id", "url", "text", "n_chars"), [(1, "https://a.example/1", "Head\n\nÉ t", 9), (2, None, "", 0)])
