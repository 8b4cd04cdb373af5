"""Lists and nearest vectors against brute force; how little the bounded forms look at."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evipack.operators import lexical, topk, vectors
from evipack.plans import corpus
from evipack.schema import Settings
from evipack.sources import text_index

SCOPES = (["public"], ["public", "private"], [], None, ["private", None])


def table(spark, n=700):
    """Items over a skewed vocabulary: some words in most items, copies of one item, items without terms or scope."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"i{k:04}", draw.choice(["public", "private", None]) if k % 5 else "public", "", " ".join(draw.choices(words, weights, k=draw.randint(1, 60)))) for k in range(n)]
    rows += [(f"copy{k}", "public", "w0 w1", "w0 w0 w2") for k in range(80)] + [("none", "public", "", ""), ("null", "public", None, None)]
    tasks = [(t, " ".join(draw.choices(words, weights, k=draw.randint(1, 12))), SCOPES[t % 5]) for t in range(40)]
    tasks += [(100, "w0", ["public"]), (101, "w0 w1", ["public"]), (102, "unheard w0", ["public"]), (103, "", ["public"]), (104, None, ["public"]), (105, "w0 w1 w2", ["private", "public"])]
    return spark.createDataFrame(rows, "source_ref string, scope string, title string, content string"), spark.createDataFrame(tasks, "task_id long, task string, scopes array<string>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot,part,block", [(None, topk.PART, topk.BLOCK), (30, 100, 7), (0, 300, 1000), (1e9, 100, 100)])
def test_lists_from_candidates(spark, hot, part, block):
    """Any border between rare and hot terms, and any size of parts, gives the lists of all matches."""
    items, tasks = table(spark)
    index, s = corpus.index_of(items), Settings(top_k=6, wide=3)
    wanted = lexical.task_terms(tasks, index.weights)
    every = lexical.matches(lexical.postings(items), wanted)
    border = lexical.hot_from(index) if hot is None else hot
    pairs = lexical.rare_pairs(index, wanted, border).unionByName(lexical.hot_pairs(index, wanted, border, s.top_k * s.wide + 8, part, block)).distinct()
    found = lexical.scored(pairs, index, wanted)
    columns = ["task_id", "source_ref", "coverage", "text_rank", "matched"]
    for make in (lexical.loose_list, lexical.strict_list):
        assert rows_of(make(found, s).select(*columns, "rank")) == rows_of(make(every, s).select(*columns, "rank"))
    assert set(map(str, rows_of(found.select(*columns)))) <= set(map(str, rows_of(every.select(*columns))))
    assert rows_of(lexical.with_all_terms(index, wanted)) == rows_of(every.where("all_terms").select("task_id", "source_ref"))


@pytest.mark.parametrize("hot,part,block", [(None, topk.PART, topk.BLOCK), (30, 100, 7), (0, 300, 1000), (1e9, 100, 100)])
def test_lists_from_the_best_of_parts(spark, hot, part, block):
    """The lists are those of all matches; a task with a hot term has a fixed number of scored rows, also for items that share its rare terms."""
    items, tasks = table(spark)
    index, s = corpus.index_of(items), Settings(top_k=6, wide=3)
    wanted = lexical.task_terms(tasks, index.weights)
    every, found = lexical.matches(index.postings, wanted), lexical.searched(index, wanted, s, hot, part, block).persist()
    columns = ["task_id", "source_ref", "coverage", "text_rank", "matched"]
    for make in (lexical.loose_list, lexical.strict_list):
        assert rows_of(make(found, s).select(*columns, "rank")) == rows_of(make(every, s).select(*columns, "rank"))
    assert set(map(str, rows_of(found.select(*columns)))) <= set(map(str, rows_of(every.select(*columns))))
    if hot == 0:
        assert found.groupBy("task_id").count().agg(F.max("count")).first()[0] <= 2 * (s.top_k * s.wide + 8)
    pairs = lexical.candidates(index, wanted, s, hot)
    assert rows_of(pairs) == rows_of(found.select("task_id", "source_ref"))


def test_few_rows_stand_for_the_matches_of_passages(spark):
    """At sf0.1, 200 passages have 1.79 million matches; their lists come from under a tenth as many rows."""
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no table of that size")
    index = corpus.items_index(spark, sf_dir)
    passages = corpus.tasks(spark, sf_dir).where("task_id < 1000000")
    wanted = lexical.task_terms(passages, index.weights)
    assert passages.count() == 200 and lexical.candidates(index, wanted).count() < 179_000


def test_index_follows_upserts(spark, tmp_path):
    """Three upserts, one of them twice, give what an index of the last state gives."""
    items, tasks = table(spark, 300)
    items, path = items.persist(), f"{tmp_path}/index"
    text_index.create(items.where("source_ref NOT LIKE 'copy1%'").withColumn("content", F.when(F.col("source_ref").like("%7"), "w5 other").otherwise(F.col("content"))), path, 50)
    steps = [("%7", "i00%"), ("copy1%", "copy2%"), ("i001%", "none")]
    for version, (changed, gone) in enumerate(steps, 1):
        for _ in range(2 if version == 2 else 1):
            text_index.update(spark, path, items.where(F.col("source_ref").like(changed)), items.where(F.col("source_ref").like(gone) & ~F.col("source_ref").like(changed)), version)
    last = items.where("source_ref NOT LIKE 'i00%' OR source_ref LIKE '%7' OR source_ref LIKE 'i001%'").where("source_ref NOT LIKE 'copy2%' AND source_ref <> 'none'")
    index, anew = text_index.load(spark, path), corpus.index_of(last)
    assert index.n_items == anew.n_items == last.count()
    assert rows_of(index.postings.select("source_ref", "scope", "n_terms", "term", "tf")) == rows_of(lexical.postings(last).select("source_ref", "scope", "n_terms", "term", "tf"))
    weight = lambda x: rows_of(x.weights.select("term", "df", F.round("weight", 9)))
    assert weight(index) == weight(anew)


def brute(queries, items, k, scopes=None, kinds=None):
    found = set()
    for q, (a, own) in enumerate(zip(queries, scopes or [None] * len(queries), strict=True)):
        length = np.linalg.norm(a) * np.linalg.norm(items, axis=1)
        cosine = np.round(np.divide(items @ a, length, out=np.zeros(len(items)), where=length > 0), 9)
        may = [i for i in range(len(items)) if kinds is None or kinds[i] is not None and kinds[i] in (own or [])]
        found |= {(q, i, rank) for rank, i in enumerate(sorted(may, key=lambda i: (-cosine[i], i))[:k], 1)}
    return found


def test_nearest_vectors(spark):
    """Clusters, copies of one vector, zero and null vectors, and mixed, empty and null scopes."""
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(6, 8))
    items = np.concatenate([c + 0.05 * draw.normal(size=(60, 8)) for c in centers] + [np.tile(centers[0], (90, 1)), np.zeros((5, 8))])
    queries = np.concatenate((items[::40] + 0.01 * draw.normal(size=(12, 8)), np.zeros((1, 8))))
    kinds = [("public", "private", None)[i % 3] for i in range(len(items))]
    asked = [SCOPES[q % 5] for q in range(len(queries))]
    left = spark.createDataFrame([(q, a.tolist(), s) for q, (a, s) in enumerate(zip(queries, asked, strict=True))] + [(99, None, ["public"])], "vec_id long, embedding array<double>, scopes array<string>")
    right = spark.createDataFrame([(i, a.tolist(), s) for i, (a, s) in enumerate(zip(items, kinds, strict=True))] + [(9999, None, "public")], "vec_id long, embedding array<double>, scope string")
    for part, block in ((topk.PART, topk.BLOCK), (64, 5)):
        found = vectors.cosine_top_k(left, right, 7, part=part, block=block)
        assert {(r.query_id, r.item_id, r["rank"]) for r in found.collect()} == brute(queries, items, 7)
        scoped = vectors.cosine_top_k(left, right, 7, query_scopes="scopes", item_scope="scope", part=part, block=block)
        assert {(r.query_id, r.item_id, r["rank"]) for r in scoped.collect()} == brute(queries, items, 7, asked, kinds)


def test_far_clusters_are_passed_over():
    draw = np.random.default_rng(9)
    items = np.concatenate([c + 0.02 * draw.normal(size=(500, 16)) for c in draw.normal(size=(20, 16))])
    queries = items[::100] + 0.01 * draw.normal(size=(100, 16))
    keys, pairs = vectors.nearest(queries, items, 10)
    every = topk.keys(vectors._directions(queries) @ vectors._directions(items).T, np.arange(len(items))[None, :])
    assert (np.sort(keys, axis=1) == np.sort(every, axis=1)[:, -10:]).all() and pairs < 0.4 * len(queries) * len(items)


def test_many_queries_in_one_plan(spark):
    """Ten thousand queries: one read of the items, whatever their number, and no query on the driver."""
    rows = spark.range(12_000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(8)]).alias("embedding"))
    found = vectors.cosine_top_k(rows.where("vec_id < 10000"), rows.where("vec_id % 6 = 0"), 3, block=4000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan
    got = found.collect()
    assert len(got) == 30_000
    items = np.array([[np.float32(np.sin(i * (k + 1))) for k in range(8)] for i in range(0, 12_000, 6)], np.float64)
    for q in (0, 777, 9999):
        a = np.array([np.float32(np.sin(q * (k + 1))) for k in range(8)], np.float64)
        assert {(0, r.item_id // 6, r["rank"]) for r in got if r.query_id == q} == brute([a], items, 3)


def test_item_maps_count_in_place(spark, capsys):
    """The maps are the postings, a row for items without terms too, and no term leaves the task of its item."""
    items, _ = table(spark)
    maps = lexical.item_maps(items)
    found = {r.source_ref: r for r in maps.collect()}
    assert len(found) == items.count() and found["none"].tfs == {} and found["null"].n_terms == 0
    assert sorted((k, t, n) for k, r in found.items() for t, n in r.tfs.items()) == sorted((r.source_ref, r.term, r.tf) for r in lexical.postings(items).collect())
    assert all(sum(r.tfs.values()) == r.n_terms for r in found.values())
    maps.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_postings_are_sifted_before_they_are_dealt(spark):
    """However large the table of task terms, postings of terms that nobody asks for meet no exchange."""
    items, tasks = table(spark)
    index = corpus.index_of(items)
    wanted = lexical.task_terms(tasks.where("task_id = 103 OR task_id = 1"), index.weights)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lexical.matches(index.postings, wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    below = plan[plan.index("SortMergeJoin [term"):]
    assert below.index("LeftSemi") < below.index("Generate explode(tfs") and "BroadcastHashJoin [number" in below
