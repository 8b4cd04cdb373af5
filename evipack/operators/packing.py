"""Greedy packing of candidates under a token budget, and records linked to what was chosen. Folds over short lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evipack.functions.text import tokens
from evipack.schema import DEFAULTS, Settings

STATE = "struct<used:int,docs:map<string,int>,out:array<int>>"


def _fold(candidates: Column, budget: Column, s: Settings) -> Column:
    """struct(used, docs, out): out has the positions that are taken."""
    start = F.struct(F.lit(0).alias("used"), F.create_map().alias("docs"), F.array().alias("out")).cast(STATE)

    def take(a: Column, c: Column) -> Column:
        own = F.coalesce(F.element_at(a.docs, c.doc_key), F.lit(0))
        capped = (c.kind == "unstructured") & (own >= s.per_doc_cap)
        passes = (F.size(a.out) < s.max_items) & ~capped & (a.used + c.cost <= budget)
        docs = F.map_concat(F.map_filter(a.docs, lambda k, _: k != c.doc_key), F.create_map(c.doc_key, own + 1))
        return F.when(passes, F.struct((a.used + c.cost).alias("used"), docs.alias("docs"), F.array_append(a.out, c.rank).alias("out")).cast(STATE)).otherwise(a)

    return F.aggregate(candidates, start, take)


def pack(candidates: DataFrame, tasks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(task_id, n, rank, used): the candidates (task_id, rank, source, doc_id, kind, and content or its `cost` in tokens) taken, in rank order.

    An item beyond the budget is skipped and later, smaller ones still fit; at most `max_items`; at most `per_doc_cap`
    unstructured items of one document, where every item taken counts.
    """
    cost = F.col("cost") if "cost" in candidates.columns else tokens(F.col("content"))
    own = F.struct(
        "rank", cost.alias("cost"), "kind", F.concat_ws("\u0001", "source", F.coalesce("doc_id", F.lit(""))).alias("doc_key")
    )
    lists = candidates.groupBy("task_id").agg(F.array_sort(F.collect_list(own)).alias("own"))
    packed = lists.join(tasks.select("task_id", "budget_tokens"), "task_id").select("task_id", _fold(F.col("own"), F.col("budget_tokens"), s).alias("p"))
    return packed.select("task_id", F.posexplode("p.out").alias("pos", "rank"), F.col("p.used").alias("used")).withColumn("n", F.col("pos") + 1).drop("pos")


LINK = "struct<used:int,n:int,have:array<string>,out:array<struct<ref:string,n:int,parent:int>>>"


def link_records(chosen: DataFrame, records: DataFrame, tasks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(task_id, n, parent, source_ref, used): records of the documents behind chosen releases and facts.

    `chosen` has task_id, n, source, source_ref, doc_id and used. A record is added if it is in scope, not there yet,
    within the budget, and the package has room; used goes on from the packing.
    """
    wanted = chosen.withColumn("record_ref", F.when(F.col("source").isin("press_release", "financial_fact"), F.concat(F.lit("record/"), "doc_id")))
    side = records.select(F.col("source_ref").alias("record_ref"), F.col("scope").alias("record_scope"), tokens(F.col("content")).alias("cost"))
    found = wanted.join(side, "record_ref", "left").join(tasks.select("task_id", "budget_tokens", "scopes"), "task_id")
    usable = F.when(F.array_contains("scopes", F.col("record_scope")), F.col("record_ref"))
    lists = found.groupBy("task_id", "budget_tokens").agg(
        F.array_sort(F.collect_list(F.struct("n", usable.alias("ref"), "cost"))).alias("own"), F.collect_set("source_ref").alias("have"),
        F.max("used").alias("used"), F.count(F.lit(1)).cast("int").alias("held"),
    )
    start = F.struct(F.col("used"), F.col("held").alias("n"), F.col("have"), F.array().alias("out")).cast(LINK)

    def add(a: Column, c: Column) -> Column:
        passes = c.ref.isNotNull() & ~F.array_contains(a.have, c.ref) & (a.used + c.cost <= F.col("budget_tokens")) & (a.n < s.max_items)
        more = F.struct(c.ref.alias("ref"), (a.n + 1).alias("n"), c.n.alias("parent"))
        taken = F.struct((a.used + c.cost).alias("used"), (a.n + 1).alias("n"), F.array_append(a.have, c.ref).alias("have"), F.array_append(a.out, more).alias("out"))
        return F.when(passes, taken.cast(LINK)).otherwise(a)

    linked = lists.select("task_id", F.aggregate("own", start, add).alias("p"))
    return linked.select("task_id", F.explode("p.out").alias("r"), F.col("p.used").alias("used")).select("task_id", "r.n", "r.parent", F.col("r.ref").alias("source_ref"), "used")
