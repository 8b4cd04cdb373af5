"""Files by document, evidence of very frequent keys, caches, request metrics over a stream, and measures of a run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evipack.operators import evaluate, facts, hooks, incremental
from evipack.sources import folder, readers
from evipack.streaming import streams


def test_documents_as_files(spark, tmp_path):
    """Ids stay as they are, texts too but for line ends; empty files are none to Spark."""
    rows = [("007", "a\r\nb\rc\n"), ("1e3", "1"), ("none", ""), ("true", None), ("a b+c%20.é", "x" * 100_000), ("2024-01-01", "\n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    folder.write_documents(docs, f"{tmp_path}/docs")
    found = {r.doc_id: r.text for r in readers.read_documents(spark, f"{tmp_path}/docs").collect()}
    assert found == {"007": "a\nb\nc\n", "1e3": "1", "a b+c%20.é": "x" * 100_000, "2024-01-01": "\n"}
    assert (tmp_path / "docs" / "007.txt").read_bytes() == b"a\r\nb\rc\n"
    for bad in ("a/b", "", None, ".."):
        with pytest.raises(Exception, match="no file can have the name"):
            folder.write_documents(spark.createDataFrame([(bad, "x")], "doc_id string, text string"), f"{tmp_path}/docs")


def test_no_list_of_files_on_the_driver(spark, tmp_path):
    """Many files are read by their names in a table; names that Spark's sources would hide, odd bytes and other files beside them."""
    rows = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(F.lit("text\r\n"), "id").alias("text"))
    more = spark.createDataFrame([("_hidden", "a"), (".dot", "b"), ("é +%41", "c\r")], "doc_id string, text string")
    path = f"{tmp_path}/docs with a blank"
    folder.write_documents(rows.unionByName(more), path)
    (tmp_path / "docs with a blank" / "bytes.txt").write_bytes(b"a\xff")
    (tmp_path / "docs with a blank" / "other.csv").write_bytes(b"no document")
    (tmp_path / "docs with a blank" / "inner.txt").mkdir()
    docs = readers.read_documents(spark, path)
    assert len(docs.inputFiles()) < 10
    found = {r.doc_id: r.text for r in docs.where("doc_id <> 'bytes'").collect()}
    assert found == {f"d{k}": f"text\n{k}" for k in range(5000)} | {"_hidden": "a", ".dot": "b", "é +%41": "c\n"}
    assert docs.where("doc_id = 'bytes'").select(F.hex(F.col("text").cast("binary"))).first()[0] in ("61FF", "61EFBFBD")
    by_spark = readers.read_documents(spark, f"{tmp_path}/docs*blank")  # a pattern is Spark's to read
    assert by_spark.where("doc_id LIKE 'd%'").count() == 5000


def test_evidence_of_a_hot_key(spark):
    """A key with a million rows beside small ones: every place once, in order, over many slices."""
    k = F.col("id")
    rows = spark.range(1_000_300).select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 7, "0")).alias("source_ref"), F.when(k < 1_000_000, "hot").otherwise(F.concat(F.lit("k"), (k % 100).cast("string"))).alias("fact_key"),
        (k % 3).cast("string").alias("fact_value"), F.timestamp_add("SECOND", (F.pmod(F.xxhash64("id"), F.lit(5000))).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("observed_at"), F.lit(0.5).alias("confidence"),
    )
    found = facts.ordered_evidence(rows, slice_rows=100_000)
    slices = found.groupBy("fact_key").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.max("pos").alias("last"), F.first("n_rows").alias("n_rows"), F.first("n_values").alias("v"))
    held = {r.fact_key: r for r in slices.collect()}
    assert len(held) == 101 and held["hot"].n == held["hot"].places == held["hot"].n_rows == held["hot"]["last"] + 1 == 1_000_000 and held["hot"].v == 3
    assert all(r.n == r.places == r["last"] + 1 == 3 for key, r in held.items() if key != "hot")
    # each row comes after the one before it: newest first, then by its key
    ahead = found.where("fact_key = 'hot'").select("pos", "observed_at", "source_ref")
    after = ahead.select((F.col("pos") - 1).alias("pos"), F.struct((-F.unix_seconds(F.col("observed_at").cast("timestamp"))).alias("t"), "source_ref").alias("b"))
    wrong = ahead.withColumn("a", F.struct((-F.unix_seconds(F.col("observed_at").cast("timestamp"))).alias("t"), "source_ref")).join(after, "pos").where("a >= b")
    assert wrong.count() == 0
    winner = facts.audit(rows).where("fact_key = 'hot'").first()
    assert winner.winner_ref == found.where("fact_key = 'hot' AND pos = 0").first().source_ref


def test_cache_calls_the_writer_once_per_hash(spark, tmp_path):
    path, calls = f"{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def writer(document, chunk):
        calls.add(1)
        return document.upper()

    incremental.create_cache(spark, path)
    kind = "chunk_hash string, document string, chunk string"
    batches = [[("a", "one", ""), ("b", "two", "")], [("a", "one", ""), ("b", "two", "")], [("b", "two", ""), ("c", "three", ""), ("c", "three", ""), ("d", None, "")], []]
    for batch in batches:
        incremental.cache_missing(spark, path, spark.createDataFrame(batch, kind), lambda rows: hooks.write_notes(rows, writer))
    assert sorted((r.chunk_hash, r.note) for r in incremental.read_cache(spark, path).collect()) == [("a", "ONE"), ("b", "TWO"), ("c", "THREE"), ("d", "")]
    assert calls.value == 4


def test_vector_cache(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    incremental.create_cache(spark, path, "embedding array<float>")
    rows = spark.createDataFrame([("h1", "net revenue", "grew"), ("h2", "", "")], "chunk_hash string, title string, content string")
    for _ in range(2):
        incremental.cache_missing(spark, path, rows, lambda fresh: fresh.select("chunk_hash", hooks.encode(F.col("title"), F.col("content")).alias("embedding")))
    assert {r.chunk_hash: len(r.embedding) for r in incremental.read_cache(spark, path).collect()} == {"h1": 64, "h2": 64}


def test_request_metrics_leave_out_late_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    kind = "ts timestamp, task_id long, items long, tokens_used long, candidates long, warnings map<string,long>"
    runs = [
        [(at(1, 5), 1, 3, 100, 30, {"stale": 1}), (at(1, 50), 2, 0, 0, 5, {"missing": 2}), (at(5), 3, 8, 900, 30, {}), (None, 9, 1, 1, 1, {})],
        [(at(1, 10), 4, 1, 10, 1, {"conflict": 1}), (at(3, 30), 5, 2, 20, 2, None), (at(8), 6, 1, 5, 9, {})],  # the first is too late: 1:00 to 2:00 was closed at 3:00
        [(at(12), 7, 1, 1, 1, {})],
    ]
    log, path, marks = (f"{tmp_path}/{n}" for n in ("log", "out", "marks"))
    for run in runs:
        spark.createDataFrame(run, kind).coalesce(1).write.mode("append").parquet(log)
        streams.stream_request_metrics(spark, log, path, marks)
        streams.stream_request_metrics(spark, log, path, marks)  # nothing new has come
    got = {r.window_start.hour: (r.requests, r["items"], r.tokens_used, r.candidates, r.missing, r.stale, r.duplicate, r.conflict) for r in spark.read.parquet(path).collect()}
    assert got == {1: (2, 3, 100, 35, 2, 1, 0, 0), 3: (1, 2, 20, 2, 0, 0, 0, 0), 5: (1, 8, 900, 30, 0, 0, 0, 0), 8: (1, 1, 5, 9, 0, 0, 0, 0)}
    whole = {r.window_start.hour: r.requests for r in streams.request_metrics(spark.read.parquet(log).where("ts IS NOT NULL")).collect()}
    assert whole == {1: 3, 3: 1, 5: 1, 8: 1, 12: 1}


def test_measures_of_a_run(spark):
    class Package:
        items = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, ""), (2, 1, "abcd")], "task_id long, n int, content string")

    run = evaluate.measured_run(lambda: Package, 4)
    assert (run["items"], run["with_items"], run["tokens"], run["tasks"], run["items_per_package"]) == (3, 2, 11 + 1 + 2, 4, 0.75)
    assert 0 < run["seconds"] < 60 and run["ms_per_task"] == 250 * run["seconds"]


def test_packages_and_metrics_are_written_and_read(spark, tmp_path):
    class Package:
        heads = spark.createDataFrame([(1, 10), (2, 0)], "task_id long, tokens_used int")
        items = spark.createDataFrame([(1, 1, ["why"])], "task_id long, n int, why array<string>")
        evidence = spark.createDataFrame([(1, "r")], "task_id long, source_ref string")
        warnings = spark.createDataFrame([], "task_id long, kind string")

    for _ in range(2):
        readers.write_package(Package, f"{tmp_path}/package")
    found = readers.read_package(spark, f"{tmp_path}/package")
    assert {name: sorted(map(tuple, df.collect())) for name, df in found.items()} == {"heads": [(1, 10), (2, 0)], "items": [(1, 1, ["why"])], "evidence": [(1, "r")], "warnings": []}
    readers.write_metrics(spark.createDataFrame([("lexical", 0.5)], "configuration string, hit_rate double"), f"{tmp_path}/metrics")
    assert spark.read.schema("configuration string, hit_rate double").json(f"{tmp_path}/metrics").collect() == [("lexical", 0.5)]


def test_conflict_message_lists_every_row(spark):
    """The message of a conflict names each row of its key in order; keys that agree have none."""
    rows = [(f"r{n}", "k", str(n % 3), dt.datetime(2024, 1, 1 + n % 5), 0.5) for n in range(40)] + [("a", "same", "1", None, 0.5), ("b", "same", "1,", None, 0.5), ("x", "two", "1", None, 0.9), ("y", "two", "2", dt.datetime(2024, 2, 1), 0.1)]
    df = spark.createDataFrame(rows, "source_ref string, fact_key string, fact_value string, observed_at timestamp_ntz, confidence double")
    found = {r.fact_key: r for r in facts.listed_conflicts(df).collect()}
    assert set(found) == {"k", "two"} and found["two"].winner_ref == "y"
    assert found["two"].message == "2 values are given for two: 2 in y of 2024-02-01, trust 0.1; 1 in x of no date, trust 0.9"
    order = sorted(rows[:40], key=lambda r: (-r[3].day, r[0]))
    assert found["k"].message == "3 values are given for k: " + "; ".join(f"{r[2]} in {r[0]} of {r[3]:%Y-%m-%d}, trust 0.5" for r in order)
    assert (found["k"].winner_ref, found["k"].n_rows, found["k"].n_values) == (order[0][0], 40, 3)
