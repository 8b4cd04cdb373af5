"""Operators on small tables: known answers, quirks, idempotence, and the stream against the batch."""

import datetime as dt
import glob
import json
import os
import random

from pyspark.sql import functions as F

from evipack.operators import evaluate, facts, fusion, hooks, incremental, lexical, package, packing, vectors
from evipack.plans import corpus
from evipack.sources import normalize, readers, store
from evipack.streaming import streams

FACT = "source_ref string, fact_key string, fact_value string, observed_at timestamp_ntz, confidence double"


def day(y, m, d):
    return dt.datetime(y, m, d)


def test_conflict_and_duplicate(spark):
    rows = [
        ("a", "Service|FY 2022", "91,988", day(2024, 2, 25), 0.85), ("b", "Service|FY 2022", "91,947", day(2023, 3, 2), 0.6), ("c", "Service|FY 2022", "91947", day(2023, 2, 25), 0.85),
        ("d", "Dividend|FY 2023", "0.77", day(2024, 1, 1), 0.6), ("e", "Dividend|FY 2023", " 0.77", None, 0.9), ("f", "Alone|FY 2023", "1", None, 0.6),
    ]
    df = spark.createDataFrame(rows, FACT)
    conflict = facts.conflicts(df).collect()
    assert [(r.fact_key, r.winner_ref, r.n_rows, r.n_values) for r in conflict] == [("Service|FY 2022", "a", 3, 2)]
    lines = {r.pos: (r.source_ref, r.line) for r in facts.conflict_lines(df).collect()}
    assert [lines[k][0] for k in range(3)] == ["a", "b", "c"] and lines[1][1] == "91,947 in b of 2023-03-02, trust 0.6"
    assert conflict[0].message == "2 values are given for Service|FY 2022 by 3 sources; 91,988 of a stands"
    assert [(r.fact_key, r.winner_ref) for r in facts.duplicates(df).collect()] == [("Dividend|FY 2023", "d")]


def test_fusion_adds_every_list(spark):
    rows = [(1, "x", "lexical", 0, 1), (1, "x", "lexical", 1, 1), (1, "x", "dense", 2, 6), (1, "y", "dense", 2, 1)]
    found = {r.source_ref: r for r in fusion.fuse(spark.createDataFrame(rows, "task_id int, source_ref string, channel string, list_no int, rank int")).collect()}
    assert round(found["x"].score, 4) == 0.0479 and found["x"].ranks == {"lexical": 1, "dense": 6} and found["x"]["rank"] == 1
    gate = lambda s, c, r: spark.range(1).select(fusion.relevant(F.lit(s).cast("double"), F.lit(c), F.create_map(F.lit("dense"), F.lit(r)))).first()[0]
    assert [gate(3.9, 1.0, 1), gate(4.0, 0.0, 99), gate(None, 0.3, 99), gate(None, 0.1, 10), gate(None, 0.1, 11)] == [False, True, True, True, False]


def test_scopes_and_channels(spark):
    principals = spark.createDataFrame([("k", "agent", ["public"])], "api_key string, agent string, scopes array<string>")
    tasks = spark.createDataFrame([(1, "k"), (2, "other")], "task_id int, api_key string")
    assert [r.task_id for r in fusion.with_scopes(tasks, principals).collect()] == [1]
    assert [r.task_id for r in fusion.rejected(tasks, principals).collect()] == [2]
    pick = lambda asked, have: spark.range(1).select(fusion.chosen_channels(F.array(*map(F.lit, asked)).cast("array<string>"), have)).first()[0]
    assert pick([], ["lexical", "dense", "lexical_ctx", "dense_ctx"]) == ["lexical_ctx", "dense_ctx"]
    assert pick(["dense", "lexical"], ["lexical"]) == ["lexical"] and pick([], ["lexical", "dense"]) == ["lexical", "dense"]


CANDIDATE = "task_id int, rank int, source string, doc_id string, kind string, content string"


def packed(spark, rows, budget=1000):
    tasks = spark.createDataFrame([(1, budget, ["public"])], "task_id int, budget_tokens int, scopes array<string>")
    found = packing.pack(spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows, 1)], CANDIDATE), tasks).orderBy("n").collect()
    return [r["rank"] for r in found], found[0].used if found else 0


def test_packing(spark):
    u, s = "unstructured", "structured"
    assert packed(spark, [("p", "1", u, "x" * 400), ("p", "2", u, "x" * 4000), ("p", "3", u, "x" * 40)], 120) == ([1, 3], 112)  # too large is skipped
    assert packed(spark, [("p", "1", u, "x")] * 4)[0] == [1, 2]  # two of one document
    assert packed(spark, [("internal_note", "7", s, "x"), ("internal_note", "7", s, "x"), ("internal_note", "7", u, "x"), ("q", "7", u, "x")])[0] == [1, 2, 4]  # facts count too
    assert packed(spark, [("p", str(k), s, "x") for k in range(12)])[0] == list(range(1, 9))


def test_link_records(spark):
    chosen = spark.createDataFrame([(1, 1, "press_release", "press_release/5#0", "5", 10), (1, 2, "financial_fact", "f", "5", 10), (1, 3, "internal_note", "n", "6", 10), (1, 4, "press_release", "p", "8", 10)], "task_id int, n int, source string, source_ref string, doc_id string, used int")
    records = spark.createDataFrame([("record/5", "public", "x" * 40), ("record/6", "public", "x"), ("record/8", "private", "x")], "source_ref string, scope string, content string")
    tasks = spark.createDataFrame([(1, 100, ["public"])], "task_id int, budget_tokens int, scopes array<string>")
    assert [tuple(r) for r in packing.link_records(chosen, records, tasks).collect()] == [(1, 5, 1, "record/5", 21)]


def test_ingest_is_idempotent(spark):
    kind = "source_ref string, content_hash string, title string"
    store = spark.createDataFrame([("a", "1", "A"), ("b", "1", "B"), ("c", "1", "C")], kind)
    raw = spark.createDataFrame([("a", "1", "A"), ("b", "2", "B2"), ("d", "1", "D")], kind)
    changed, gone = incremental.find_changed(raw, store), incremental.removed(raw, store)
    following = incremental.upsert(store, changed, gone)
    assert sorted(map(tuple, following.collect())) == sorted(map(tuple, raw.collect()))
    assert incremental.find_changed(raw, following).count() == incremental.removed(raw, following).count() == 0
    twice = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "source_ref string, content_hash string, place int")
    assert [r.content_hash for r in incremental.last_of_each(twice, "place").collect()] == ["2"]
    lacking = store.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert incremental.find_changed(raw, lacking, ("embedding",)).count() == 3


def test_adapters(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/1.txt").write_bytes(b"Bonn, March 5, 2024.\r\nFirst line")
    recs = [{"doc_id": "1", "title": "old", "summary": "s"}, {"doc_id": "1", "title": "T", "summary": "S.", "people": ["P"]}, {"doc_id": "9", "title": "U", "summary": "V."}]
    (tmp_path / "records.jsonl").write_text("\n".join(map(json.dumps, recs)))
    note = {"id": "n1", "channel": "ops", "author": "Kim", "sent_at": "2024-01-02T03:04:05", "scope": "private", "text": "hello", "facts": [{"key": "Staff|FY 2023", "value": "5"}]}
    (tmp_path / "notes.jsonl").write_text(json.dumps(note))
    docs, records, notes = readers.read_documents(spark, f"{tmp_path}/docs"), readers.read_records(spark, f"{tmp_path}/records.jsonl"), readers.read_notes(spark, f"{tmp_path}/notes.jsonl")
    items = normalize.all_items(normalize.press_releases(docs, records, []), normalize.records(records, docs), normalize.financial_facts(docs, "The company"), normalize.internal_notes(notes), normalize.note_facts(notes, "The company"))
    found = {r.source_ref: r for r in items.collect()}
    assert set(found) == {"press_release/1#0", "record/1", "record/9", "internal_note/n1", "internal_note/n1:fact0"}
    assert found["press_release/1#0"].title == "T" and found["press_release/1#0"].content == "Bonn, March 5, 2024.\nFirst line"
    assert found["record/1"].content == "T. S. People: P." and found["record/1"].observed_at == day(2024, 3, 5)
    assert found["record/9"].timestamp_precision == "unknown" and found["internal_note/n1:fact0"].scope == "private"
    assert found["internal_note/n1:fact0"].fact_key == "Staff|FY 2023" and all(r.content_hash for r in found.values())
    readers.write_items(items, f"{tmp_path}/items")
    assert readers.read_hashes(spark, f"{tmp_path}/items").count() == 5


def test_vectors_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 20 = 0")
    few, all_at_once = (sorted(map(tuple, vectors.cosine_top_k(queries, df, 5, block=b, part=4 * b).collect())) for b in (2, 1000))
    assert few == all_at_once and len(few) == 3 * 5


def test_hooks(spark):
    df = spark.createDataFrame([("h", "First one. Second.", "c")], "chunk_hash string, document string, chunk string")
    assert hooks.write_notes(df).first().note == "First one"
    vector = df.select(hooks.encode(F.col("document"), F.col("chunk"))).first()[0]
    assert abs(sum(x * x for x in vector) - 1) < 1e-5
    hits = spark.createDataFrame([(1, "r", "t", "a", "b")], "task_id int, source_ref string, task string, title string, content string")
    assert hooks.rerank_scores(hits, lambda *_: 12).first().rerank_score == 10.0


def test_rendering(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    items = spark.createDataFrame([(1, 1, "[1]", "First sentence. Second sentence.")], "task_id int, n int, ref string, content string")
    warnings = spark.createDataFrame([(1, "stale", "old")], "task_id int, kind string, message string")
    found = dict(package.extractive_answers(tasks, items, warnings).collect())
    assert found[1] == "- First sentence. [1]\n- Warning (stale): old" and "no answer" in found[2]


def test_citation_coverage(spark):
    text = F.lit("This is a long sentence with a tag [1]. This one is long but has no tag at all. Short.")
    assert spark.range(1).select(evaluate.citation_coverage(text, F.array(F.lit("[1]")))).first()[0] == 0.5


def test_stream_equals_batch(spark, tmp_path):
    kind = "source_ref string, content_hash string"
    landing, path, marks = (f"{tmp_path}/{n}" for n in ("landing", "store", "marks"))
    store.create(spark.createDataFrame([], kind), path)
    spark.createDataFrame([("a", "1"), ("b", "1")], kind).write.mode("append").parquet(landing)
    streams.stream_ingest(spark, landing, kind, lambda b: b, path, marks, "content_hash")
    spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "1")], kind).write.mode("append").parquet(landing)
    streams.stream_ingest(spark, landing, kind, lambda b: b, path, marks, "content_hash")
    streams.stream_ingest(spark, landing, kind, lambda b: b, path, marks, "content_hash")
    assert sorted(map(tuple, store.load(spark, path).select("source_ref", "content_hash").collect())) == [("a", "1"), ("b", "2"), ("c", "1")]


def test_postings_and_matches(spark):
    """Counts by item and term, null and empty texts included; both need no exchange of postings by item."""
    rows = [("a", "public", "Net", "revenue revenue grew"), ("b", "private", None, "revenue fell"), ("c", "public", "", ""), ("d", "public", None, None)]
    items = spark.createDataFrame(rows, "source_ref string, scope string, title string, content string")
    posts = lexical.postings(items)
    assert sorted((r.source_ref, r.term, r.tf, r.n_terms) for r in posts.collect()) == [("a", "grew", 1, 4), ("a", "net", 1, 4), ("a", "revenue", 2, 4), ("b", "fell", 1, 2), ("b", "revenue", 1, 2)]
    assert {r.term: r.df for r in lexical.idf(items, posts).collect()} == {"grew": 1, "net": 1, "revenue": 2, "fell": 1}
    tasks = spark.createDataFrame([(1, "net revenue", ["public"]), (2, "revenue", ["public", "private"])], "task_id long, task string, scopes array<string>")
    found = lexical.matches(posts, lexical.task_terms(tasks, lexical.idf(items, posts))).collect()
    assert sorted((r.task_id, r.source_ref, r.matched, r.all_terms) for r in found) == [(1, "a", ["net", "revenue"], True), (2, "a", ["revenue"], True), (2, "b", ["revenue"], True)]


def test_configurations_are_tasks_of_their_own(spark):
    rows = corpus.configured(spark.createDataFrame([(1,), (2,)], "task_id long")).collect()
    assert sorted((r.task_id, r.config) for r in rows) == [(5 * t + k, k) for t in (1, 2) for k in range(5)]


def test_store_keeps_the_newest(spark, tmp_path):
    """Changed, new and deleted keys, over and over, the same upsert twice, and parts that are folded or lose every row."""
    kind, path = "source_ref string, content_hash string", f"{tmp_path}/store"
    now = {f"k{i}": "1" for i in range(200)}
    store.create(spark.createDataFrame(list(now.items()), kind), path, 20)
    draw = random.Random(5)
    for version in range(1, 7):
        changed = {f"k{draw.randrange(260)}": str(version) for _ in range(30)}
        gone = {f"k{draw.randrange(260)}" for _ in range(200 if version == 4 else 12)} - set(changed)
        before = dict(now)
        now = {k: v for k, v in {**now, **changed}.items() if k not in gone}
        for _ in range(2 if version % 2 else 1):
            store.merge(spark, path, spark.createDataFrame(list(changed.items()), kind), spark.createDataFrame([(g,) for g in gone], "source_ref string"), version)
            assert dict(store.load(spark, path).collect()) == now
            assert dict(store.load(spark, path, before=version).collect()) == before
    assert spark.read.parquet(f"{path}/base").where("version > 0").count() > 0  # some parts were folded
    assert store.next_version(spark, path) == 7


def test_upsert_writes_what_has_changed(spark, tmp_path):
    """One key in a hundred, anywhere: under a twentieth of the store's bytes is written."""
    path = f"{tmp_path}/store"
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("source_ref"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    store.create(rows, path, 4000)
    size = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{path}/*/*/*.parquet")}
    before = size()
    changed = rows.where(F.pmod(F.xxhash64("source_ref", F.lit(3)), F.lit(100)) == 0).withColumn("content_hash", F.lit("new"))
    store.merge(spark, path, changed, rows.select("source_ref").limit(0))
    after = size()
    assert sum(s for f, s in after.items() if f not in before) < 0.05 * sum(before.values()) and set(before) <= set(after)
    assert store.load(spark, path).where("content_hash = 'new'").count() == changed.count()



def test_reconcile(spark):
    """A fact comes as its newest in-scope row, with the hit's score, all rows as evidence, and a warning."""
    row = lambda ref, value, d, scope="public", key="Sales|FY 2022": (ref, key, value, day(2023, 1, d), 0.6, "internal_note", "d", "structured", ref, f"text {ref}", {"value": value}, "day", scope, ref)
    kind = "source_ref string, fact_key string, fact_value string, observed_at timestamp_ntz, confidence double, source string, doc_id string, kind string, title string, content string, fields map<string,string>, timestamp_precision string, scope string, content_hash string"
    items = spark.createDataFrame([row("a", "5", 1), row("b", "6", 3), row("c", "7", 9, "private"), row("d", "1", 1, key="Staff|FY 2022"), row("e", "1", 2, key="Staff|FY 2022"), row("f", None, 1, key=None)], kind)
    hits = items.where("source_ref IN ('a', 'd', 'f')").selectExpr("1L AS task_id", "*", "array('public') AS scopes", "0.5 AS score", "array('why') AS why", "CASE source_ref WHEN 'a' THEN 1 WHEN 'd' THEN 2 ELSE 3 END AS rank")
    found = facts.reconcile(hits, facts.group_of_hits(hits, items.where("fact_key IS NOT NULL"))).orderBy("rank").collect()
    assert [(r.source_ref, [e.source_ref for e in r.evidence], r.warning and r.warning.kind, len(r.why)) for r in found] == [("b", ["b", "a"], "conflict", 2), ("e", ["e", "d"], "duplicate", 2), ("f", ["f"], None, 1)]
    assert found[0].warning.refs == ["b", "a"] and "stands" in found[0].warning.resolution


def test_vectors_keep_to_scopes(spark):
    rows = [(k, [float(k), 1.0], ("public", "private")[k % 2], ["public"] if k % 4 else ["public", "private"]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, scope string, scopes array<string>")
    found = vectors.cosine_top_k(df.where("vec_id % 4 < 2"), df, 50, block=3, query_scopes="scopes", item_scope="scope").collect()
    assert {(r.query_id, r.item_id) for r in found} == {(q, i) for q in range(40) if q % 4 < 2 for i in range(40) if i % 2 == 0 or q % 4 == 0}


def test_case_checks(spark):
    """One expected document is enough; every other demand counts, and what is null is not asked for."""
    cases = spark.createDataFrame(
        [(1, ["5", "9"], ["structured"], "stale", "7", "x/", 2), (2, ["9"], None, None, None, None, None), (3, None, ["a", "b"], "conflict", "8", "note/", 0), (4, None, None, None, None, None, 0)],
        "task_id long, expected_docs array<string>, expected_kinds array<string>, expected_warning string, expected_value string, excluded_prefix string, max_items int",
    )
    items = spark.createDataFrame([(k, "structured", {"value": "7"}) for k in (1, 2, 3)], "task_id long, kind string, fields map<string,string>")
    evidence = spark.createDataFrame([(k, "5", "note/1") for k in (1, 2, 3)], "task_id long, doc_id string, source_ref string")
    warnings = spark.createDataFrame([(1, "stale")], "task_id long, kind string")
    found = {r.task_id: (r.passed, r.failed) for r in evaluate.case_checks(cases, items, evidence, warnings).collect()}
    assert found == {1: (True, ""), 2: (False, "docs"), 3: (False, "kinds,warning,value,excluded,items"), 4: (True, "")}
