"""Scopes, channels, rank fusion, rerank order, relevance and reasons, for many tasks at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evipack.schema import CHANNELS, DEFAULTS, Settings

PREFERENCE = (("lexical_ctx", "lexical"), ("dense_ctx", "dense"))


def with_scopes(tasks: DataFrame, principals: DataFrame) -> DataFrame:
    """Tasks with the scopes of their key; tasks with an unknown key are left out."""
    return tasks.join(principals.select("api_key", "agent", "scopes"), "api_key")


def rejected(tasks: DataFrame, principals: DataFrame) -> DataFrame:
    return tasks.join(principals.select("api_key"), "api_key", "left_anti")


def in_scope(scopes: Column, scope: Column) -> Column:
    return F.array_contains(scopes, scope)


def chosen_channels(requested: Column, available: list[str]) -> Column:
    """Requested channels that are available; without a request, the contextual form of each kind if there is one."""
    preferred = [next((c for c in pair if c in available), None) for pair in PREFERENCE]
    default = F.array(*[F.lit(c) for c in preferred if c])
    have = F.array(*[F.lit(c) for c in available])
    return F.when(F.size(F.coalesce(requested, F.array().cast("array<string>"))) > 0, F.array_intersect(requested, have)).otherwise(default)


def fuse(lists: DataFrame, s: Settings = DEFAULTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(task_id, source_ref, score, ranks, rank) from rows (task_id, source_ref, channel, list_no, rank).

    Every list adds 1 / (60 + rank), two lists of one channel too; ranks keeps the best rank by channel. Ties go to the
    first list and rank, then by key. Only the best k of a task stay. Columns in `carry`, alike in all lists, come along.
    """
    each = lists.withColumn("gain", 1.0 / (s.rrf_k + F.col("rank")))
    parts = each.groupBy("task_id", "source_ref").agg(
        F.array_sort(F.collect_list(F.struct("list_no", "rank", "channel", "gain"))).alias("own"), *[F.first(c).alias(c) for c in carry]
    )
    score = F.round(F.aggregate("own", F.lit(0.0), lambda a, x: a + x.gain), 12)
    scored = parts.select("task_id", "source_ref", score.alias("score"), "own", *carry)
    channels = F.array_distinct(F.transform("own", lambda x: x.channel))
    best = F.map_from_arrays(channels, F.transform(channels, lambda c: F.array_min(F.transform(F.filter("own", lambda x: x.channel == c), lambda x: x["rank"]))))
    turn = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("score").desc(), F.col("own")[0].list_no, F.col("own")[0]["rank"], "source_ref"))
    return scored.withColumns({"ranks": best, "rank": turn}).where(F.col("rank") <= s.top_k).drop("own")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits with rerank_score and a new rank: by that score, those without one last, then by the fused score."""
    joined = hits.join(scores, ["task_id", "source_ref"], "left")
    order = Window.partitionBy("task_id").orderBy(F.coalesce("rerank_score", F.lit(-1.0)).desc(), F.col("score").desc(), "rank", "source_ref")
    return joined.withColumn("order", F.row_number().over(order)).drop("rank").withColumnRenamed("order", "rank")


def semantic_top(ranks: Column, limit: int = DEFAULTS.semantic_rank_ok) -> Column:
    vectors = [c for c, (kind, _) in CHANNELS.items() if kind == "vector"]
    return F.exists(F.map_entries(ranks), lambda e: e.key.isin(vectors) & (e.value <= limit))


def relevant(rerank_score: Column, coverage: Column, ranks: Column, s: Settings = DEFAULTS) -> Column:
    """A rerank score decides alone; without one, coverage or a high rank on a vector channel."""
    return F.when(rerank_score.isNotNull(), rerank_score >= s.rerank_min_score).otherwise((coverage >= s.min_coverage) | semantic_top(ranks, s.semantic_rank_ok))


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def reasons(ranks: Column, coverage: Column, matched: Column, rerank_score: Column, note: Column, period: Column) -> Column:
    """Why a hit is there: its rank by channel, what it covers, its rerank score, its note, its period."""
    covers = F.concat(F.lit(", covers "), percent(coverage), F.lit(" of what the task asks: "), F.array_join(F.slice(matched, 1, 6), ", "))
    lines = []
    for channel, (kind, label) in CHANNELS.items():
        rank = F.element_at(ranks, F.lit(channel))
        line = F.concat(F.lit(f"{label} rank "), rank.cast("string"))
        lines.append(F.when(rank.isNotNull(), F.concat(line, covers) if kind == "text" else line))
    lines.append(F.concat(F.lit("reranked at "), F.round(rerank_score, 0).cast("int").cast("string"), F.lit(" of 10")))
    lines.append(F.concat(F.lit("found with the note: "), F.substring(note, 1, 120)))
    lines.append(F.concat(F.lit("a fact of "), period))
    return F.filter(F.array(*lines), lambda x: x.isNotNull())
