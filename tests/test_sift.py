"""Rows told apart where they lie: the same rows as joins give, and how little of wide tables shuffles."""

import pytest
from pyspark.sql import functions as F

from evipack.operators import lexical
from evipack.plans import resolve as rs
from evipack.sources import sift, store, text_index
from evipack.stored import stored


def shuffled(spark, act) -> int:
    """Bytes that `act` writes for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    act()
    return written() - before


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide(spark, n):
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 512) for k in range(4)])
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("source_ref"), text.alias("content"))


@pytest.mark.parametrize("keys", [0, 1, 300, 3000])
def test_same_rows_as_joins(spark, keys, monkeypatch):
    """Also with so few bits that most rows are let through, and with keys that no row has or that come twice."""
    rows = wide(spark, 2000).persist()
    asked = spark.range(keys).select(F.concat(F.lit("k"), F.col("id") * 3 % 5000).alias("source_ref"))
    asked = asked.unionByName(asked.limit(7))
    refs = lambda df: sorted(r.source_ref for r in df.select("source_ref").collect())
    for bits, sheet in ((sift.BITS, sift.SHEET), (1, 1)):
        monkeypatch.setattr(sift, "BITS", bits)
        monkeypatch.setattr(sift, "places", (lambda k, b=bits, s=sheet: b * max(s, k.count()) if k.count() else 0))
        assert refs(sift.without(rows, asked)) == refs(rows.join(asked, "source_ref", "left_anti"))
        assert refs(sift.few(rows, asked).join(asked, "source_ref", "left_semi")) == refs(rows.join(asked, "source_ref", "left_semi"))
        assert sift.without(rows, asked).columns == sift.few(rows, asked).columns == rows.columns


def test_a_store_is_read_where_it_lies(spark, tmp_path):
    """One key in fifty is changed: neither reading the store nor reading some of its keys shuffles the others."""
    path, rows = f"{tmp_path}/store", wide(spark, 20_000)
    store.create(rows, path, 4000)
    some = rows.where(F.pmod(F.xxhash64("source_ref", F.lit(3)), F.lit(50)) == 0)
    store.merge(spark, path, some.withColumn("content", F.concat(F.lit("new"), "content")), rows.select("source_ref").where("source_ref = 'k7'"))
    size = 512 * 20_000
    assert shuffled(spark, lambda: drain(store.load(spark, path))) < 0.1 * size
    assert shuffled(spark, lambda: drain(store.load(spark, path, only=some.select("source_ref")))) < 0.1 * size
    assert store.load(spark, path).where("content LIKE 'new%'").count() == some.count() == store.load(spark, path, only=some).count()
    assert store.load(spark, path, 1, some).where("content LIKE 'new%'").count() == 0
    assert store.load(spark, path).count() == 19_999


def test_an_index_is_updated_by_what_changes(spark, tmp_path):
    """Of an index, an upsert of one item in fifty shuffles little, and so does scoring few of its items."""
    path = f"{tmp_path}/index"
    items = wide(spark, 8000).withColumns({"scope": F.lit("public"), "title": F.lit(""), "content": F.regexp_replace("content", "(.{3})", "$1 ")})
    text_index.create(items, path, 4000)
    some = items.where(F.pmod(F.xxhash64("source_ref", F.lit(3)), F.lit(50)) == 0)
    size = 512 * 8000
    assert shuffled(spark, lambda: text_index.update(spark, path, some.withColumn("content", F.lit("other words")), items.select("source_ref").limit(0))) < 0.25 * size
    index = text_index.load(spark, path)
    wanted = spark.createDataFrame([(1, "other words", ["public"])], "task_id long, task string, scopes array<string>")
    pairs = some.select(F.lit(1).cast("long").alias("task_id"), "source_ref")
    found = lexical.scored(pairs, index, lexical.task_terms(wanted, index.weights))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found.count() == some.count() and shuffled(spark, lambda: drain(found)) < 0.25 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_texts_join_what_is_chosen(spark):
    """Of many hits with long texts few fit a package: only their texts are dealt, whole, with a quote for every record that is cited."""
    n, long = 400, 512 * 4
    ident = F.col("id").cast("string")
    text = F.concat(*[F.sha2(F.concat(ident, F.lit(f"/{k}")), 512) for k in range(long // 128)])
    fact = F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), F.floor(F.col("id") / 8).cast("string")))
    store = spark.range(n).select(
        F.lit("press_release").alias("source"), F.concat(F.lit("r"), ident).alias("source_ref"), ident.alias("doc_id"), F.lit("structured").alias("kind"), F.lit("title").alias("title"), text.alias("content"),
        F.create_map(F.lit("period"), F.lit("FY 2022")).alias("fields"), fact.alias("fact_key"), (F.col("id") % 8).cast("string").alias("fact_value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("observed_at"),
        F.lit("day").alias("timestamp_precision"), F.lit("public").alias("scope"), F.lit(0.9).alias("confidence"), F.sha2(ident, 256).alias("content_hash"),
    )
    store = stored(store, "texts")
    tasks = spark.range(100).select(F.col("id").alias("task_id"), F.lit("what").alias("task"), F.array(F.lit("public")).alias("scopes"), F.lit(600).alias("budget_tokens"), F.lit("2024-07-01").cast("timestamp_ntz").alias("as_of"))
    lists = tasks.select("task_id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank")).select("task_id", F.concat(F.lit("r"), ((F.col("task_id") * 4 + F.col("rank") * 20) % n).cast("string")).alias("source_ref"), F.lit("dense").alias("channel"), F.lit(0).alias("list_no"), "rank")
    found = spark.createDataFrame([], "task_id long, source_ref string, coverage double, matched array<string>")
    made = []
    assert shuffled(spark, lambda: made.append(rs.resolve(tasks, store, rs.hits_of(tasks, store, lists, found)))) < 100 * 20 * long / 2
    items, evidence = made[0].items.collect(), made[0].evidence.collect()
    texts = {r.source_ref: r.content for r in store.collect()}
    assert len(items) == 100 and all(r.content == texts[r.source_ref] for r in items)
    assert len(evidence) == 200 and all(r.quote == texts[r.source_ref][:280] for r in evidence)


def test_passages_are_found_by_few_postings(spark):
    """However the rarest terms of tasks are joined, only postings of such terms are dealt, and only the maps and texts they find."""
    items = stored(wide(spark, 4000).withColumns({"scope": F.lit("public"), "title": F.lit(""), "content": F.regexp_replace("content", "(.{3})", "$1 ")}), "passages")
    maps = stored(lexical.item_maps(items), "passage-maps")
    posts = lexical.postings_of(maps)
    index = lexical.Index(posts, stored(lexical.idf(items, posts), "passage-weights"), maps, 4000)
    text = items.where("source_ref = 'k17'").first().content
    tasks = spark.createDataFrame([(1, text, ["public"]), (2, text + " unheard", ["public"]), (3, text, ["private"])], "task_id long, task string, scopes array<string>")
    wanted = stored(lexical.task_terms(tasks, index.weights), "passage-terms")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = []
        assert shuffled(spark, lambda: made.extend(lexical.with_all_terms(index, wanted).collect())) < 512 * 4000 / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {tuple(r) for r in made} >= {(1, "k17")} and all(r.task_id in (1, 2) for r in made)
