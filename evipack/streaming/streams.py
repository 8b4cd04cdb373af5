"""Structured Streaming forms of the ingest and of the operational metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evipack.operators import incremental
from evipack.sources import store as st


def stream_ingest(spark: SparkSession, landing: str, schema, to_items, store: str, checkpoint: str, order: str = "source_ref"):
    """Run all waiting files through the upsert; running it again changes nothing.

    `to_items` maps a batch to item rows; of rows with one key in a batch the last by `order` counts. A micro-batch is
    compared with the store by key and hash and appends what has changed, so a batch that is run again after a loss finds its rows
    in place. Absence is no deletion in a stream. `store` must exist (`sources.store.create`).
    """

    def apply(batch: DataFrame, number: int) -> None:
        raw = incremental.last_of_each(to_items(batch), order)
        known = st.load(spark, store)
        changed = incremental.find_changed(raw, known)
        st.merge(spark, store, changed, changed.select("source_ref").limit(0))

    stream = spark.readStream.schema(schema).parquet(landing)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def window_metrics(requests: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and kind: requests and summed value. `requests` has ts, kind, value; works on streams and tables."""
    timed = requests.withWatermark("ts", late) if requests.isStreaming else requests
    found = timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "kind", "requests", "total")


#: A row of the request log: when a task was resolved, and what its package holds.
REQUEST = "ts timestamp, task_id long, items long, tokens_used long, candidates long, warnings map<string,long>"
KINDS = ("missing", "stale", "duplicate", "conflict")


def request_log(heads: DataFrame, items: DataFrame, warnings: DataFrame, times: DataFrame) -> DataFrame:
    """A row of REQUEST for each package in long form; `times` (task_id, ts) says when it was asked for."""
    held = items.groupBy("task_id").agg(F.count(F.lit(1)).alias("items"))
    kinds = warnings.groupBy("task_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("warnings"))  # one entry a kind
    rows = heads.join(times, "task_id").join(held, "task_id", "left").join(kinds, "task_id", "left")
    return rows.select(
        "ts", F.col("task_id").cast("long").alias("task_id"), F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.col("tokens_used").cast("long").alias("tokens_used"),
        F.col("candidates_considered").cast("long").alias("candidates"), F.coalesce("warnings", F.create_map().cast("map<string,bigint>")).alias("warnings"),
    )


def request_metrics(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window of event time: requests, items, tokens used, candidates, and warnings by kind; over a stream or a table of REQUEST rows.

    In a stream a window is final once the latest event is `late` after its end; rows that come for it then are left out, and its state goes.
    """
    timed = log.withWatermark("ts", late) if log.isStreaming else log
    sums = [F.sum(c).alias(c) for c in ("items", "tokens_used", "candidates")]
    told = [F.sum(F.coalesce(F.element_at("warnings", F.lit(k)), F.lit(0))).alias(k) for k in KINDS]
    found = timed.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"), *sums, *told)
    return found.select(F.col("w.start").alias("window_start"), "requests", "items", "tokens_used", "candidates", *KINDS)


def stream_request_metrics(spark: SparkSession, log: str, path: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours"):
    """Take in all log files that have come and append the windows that became final to `path`; each window is written once, also when a
    run is broken off and started again. Windows that are still open stay in the state of `checkpoint`."""
    rows = request_metrics(spark.readStream.schema(REQUEST).parquet(log), width, late)
    query = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
