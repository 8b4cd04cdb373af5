"""Reconciliation of facts: winners, duplicates, conflicts, and candidates without repeats."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evipack.stored import stored

#: Rows that are put in order in one task, about.
SLICE_ROWS = 1 << 17


def comparable(value: Column) -> Column:
    """Values are compared as text without commas and outer blanks."""
    return F.trim(F.replace(value, F.lit(","), F.lit("")))


def precedence() -> Column:
    """Smallest for the newest, then the most trusted row; undated rows last, then by key."""
    return F.struct(
        F.col("observed_at").isNull().alias("undated"),
        (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("age"),
        (-F.col("confidence")).alias("doubt"),
        F.col("source_ref"),
    )


def audit(facts: DataFrame, *by: str) -> DataFrame:
    """One row per key: winner_ref, winner_value, n_rows, n_values. Combines before the shuffle, so hot keys are no burden."""
    first = F.min(F.struct(precedence().alias("p"), F.col("source_ref"), F.col("fact_value"))).alias("w")
    values = F.count_distinct(comparable(F.col("fact_value"))).alias("n_values")
    found = facts.groupBy(*by, "fact_key").agg(first, F.count(F.lit(1)).alias("n_rows"), values)
    return found.select(*by, "fact_key", F.col("w.source_ref").alias("winner_ref"), F.col("w.fact_value").alias("winner_value"), "n_rows", "n_values")


def group_of_hits(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """In-scope facts that share a key with any hit of a task: (task_id, and the facts' columns)."""
    keys = hits.where("fact_key IS NOT NULL").select("task_id", "scopes", F.col("fact_key").alias("hit_key")).distinct()
    joined = facts.join(keys, (F.col("fact_key") == F.col("hit_key")) & F.array_contains("scopes", F.col("scope")))
    return joined.drop("hit_key", "scopes")


def ordered_evidence(facts: DataFrame, *by: str, carry: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row per fact: the columns of its key, n_rows, n_values, pos (0 for the winner), source_ref, fact_value, observed_at, confidence and `carry`.

    Rows are dealt by ranges of key and precedence, so a key of any size lies in as many slices as it needs; a row's place is the
    number of its key's rows in the slices before, and its own place within its slice. No task holds a whole key.
    """
    keys = (*by, "fact_key")
    rows = facts.where("fact_key IS NOT NULL").select(*keys, "source_ref", "fact_value", "observed_at", "confidence", *carry, precedence().alias("precedence"))
    slices = max(8, -(-facts.count() // slice_rows))
    dealt = stored(rows.repartitionByRange(slices, *keys, "precedence").withColumn("slice", F.spark_partition_id()), "fact-slices")
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    whole = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(comparable(F.col("fact_value"))).alias("n_values"))
    places = held.drop("n").join(whole, list(keys))
    within = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("precedence"))
    return dealt.join(places, [*keys, "slice"]).withColumn("pos", F.col("start") + within - 1).drop("slice", "start", "precedence")


def fact_line(of=F.col) -> Column:
    """A value with its source, day and trust; `of` gives a column by name."""
    day = F.coalesce(of("observed_at").cast("date").cast("string"), F.lit("no date"))
    return F.concat(of("fact_value"), F.lit(" in "), of("source_ref"), F.lit(" of "), day, F.lit(", trust "), of("confidence").cast("string"))


def evidence(facts: DataFrame, *by: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the rows behind it, winner first, as array `evidence` (source_ref, fact_value, observed_at, confidence
    and the columns in `carry`), n_rows, n_values, winner_ref, winner_value, and `listing` of all values.

    For packages, whose items cite their evidence in one row; `ordered_evidence` is the form for keys of any size.
    """
    names = ("source_ref", "fact_value", "observed_at", "confidence", *carry)
    own = F.struct(precedence().alias("p"), *[F.col(c) for c in names])
    before = lambda a, b: F.when(a.p < b.p, -1).when(a.p > b.p, 1).otherwise(0)
    rows = facts.groupBy(*by, "fact_key").agg(F.array_sort(F.collect_list(own), before).alias("evidence"))
    return rows.withColumns({
        "n_rows": F.size("evidence").cast("long"),
        "n_values": F.size(F.array_distinct(F.transform("evidence", lambda e: comparable(e.fact_value)))).cast("long"),
        "winner_ref": F.col("evidence")[0].source_ref, "winner_value": F.col("evidence")[0].fact_value,
        "listing": F.array_join(F.transform("evidence", lambda e: fact_line(lambda name: e[name])), "; "),
    })


def duplicate_message() -> Column:
    return F.concat(F.col("n_rows").cast("string"), F.lit(" sources agree that "), "fact_key", F.lit(" is "), "winner_value")


def conflict_message() -> Column:
    return F.concat(F.col("n_values").cast("string"), F.lit(" values are given for "), "fact_key", F.lit(": "), "listing")


def duplicates(facts: DataFrame, *by: str) -> DataFrame:
    """Keys that several rows report with one value."""
    return audit(facts, *by).where("n_rows > 1 AND n_values = 1").withColumn("message", duplicate_message())


def conflicts(facts: DataFrame, *by: str) -> DataFrame:
    """Keys with more than one value: winner_ref, winner_value, n_rows, n_values and a message; the values are in `conflict_lines` and `listed_conflicts`."""
    message = F.concat(F.col("n_values").cast("string"), F.lit(" values are given for "), "fact_key", F.lit(" by "), F.col("n_rows").cast("string"), F.lit(" sources; "), "winner_value", F.lit(" of "), "winner_ref", F.lit(" stands"))
    return audit(facts, *by).where("n_values > 1").withColumn("message", message)


def conflict_lines(facts: DataFrame, *by: str) -> DataFrame:
    """Every row of the keys that conflict, the winner first (pos 0), with a line that discloses it."""
    return ordered_evidence(facts, *by).where("n_values > 1").withColumn("line", fact_line())


def listed_conflicts(facts: DataFrame, *by: str) -> DataFrame:
    """As `conflicts`, and whole: winner_ref, winner_value, n_rows, n_values and a message that lists every row of the key, the winner
    first; `conflict_lines` has a row for each of them.

    Rows of all other keys are left out before any text is made. Lines are put in order in slices of a key, so only the finished lines
    of a key meet in one task, as its message needs them.
    """
    lines = conflict_lines(facts, *by)
    own = F.array_sort(F.collect_list(F.struct("pos", "line", "source_ref", "fact_value")))
    rows = lines.groupBy(*by, "fact_key").agg(F.first("n_rows").alias("n_rows"), F.first("n_values").alias("n_values"), own.alias("own"))
    rows = rows.select(*by, "fact_key", F.col("own")[0].source_ref.alias("winner_ref"), F.col("own")[0].fact_value.alias("winner_value"), "n_rows", "n_values", F.array_join(F.transform("own", lambda x: x.line), "; ").alias("listing"))
    return rows.withColumn("message", conflict_message()).drop("listing")


def without_repeats(hits: DataFrame) -> DataFrame:
    """Relevant hits in rank order, one per fact key and one per content hash of a task."""
    hits = hits.repartition("task_id")  # once for both windows
    by_key = Window.partitionBy("task_id", F.coalesce("fact_key", "content_hash")).orderBy("rank")
    by_hash = Window.partitionBy("task_id", "content_hash").orderBy("rank")
    return hits.withColumns({"of_key": F.row_number().over(by_key), "of_hash": F.row_number().over(by_hash)}).where("of_key = 1 AND of_hash = 1").drop("of_key", "of_hash")


#: What an item brings into a package beside its key and value, and what of that can be added when the items are chosen.
ITEM = ("source", "doc_id", "kind", "title", "content", "fields", "timestamp_precision", "scope", "content_hash")
LATE = ("title", "content", "fields", "content_hash")


def reconcile(relevant: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates (task_id, rank, score, why, evidence, warning and the item columns) of relevant hits, in rank order.

    `groups` are the rows of `group_of_hits`. Of the item columns, and `cost`, those come along that `groups` has. A fact comes as the winner of its group, with the score and the reasons of the hit
    that found it, all rows of the group as evidence, and a warning (kind, message, refs, resolution) if they agree or differ.
    """
    item = [c for c in (*ITEM, "cost") if c in groups.columns]
    of = evidence(groups, "task_id", carry=tuple(item)).withColumnsRenamed({"fact_key": "group_key", "task_id": "group_task"})
    own = F.struct("source_ref", "fact_value", "observed_at", "confidence", *item)
    rows = without_repeats(relevant).withColumn("own", own)
    joined = rows.select("task_id", "rank", "score", "why", "fact_key", "own").join(of, (F.col("fact_key") == F.col("group_key")) & (F.col("task_id") == F.col("group_task")), "left")
    alone = F.array(F.col("own"))
    every = F.coalesce(F.transform("evidence", lambda e: F.struct(*[e[c].alias(c) for c in ("source_ref", "fact_value", "observed_at", "confidence", *item)])), alone)
    agreed, differ = (F.col("n_rows") > 1) & (F.col("n_values") == 1), F.col("n_values") > 1
    reason = F.when(agreed, F.concat(F.lit("confirmed by "), F.col("n_rows").cast("string"), F.lit(" sources")))
    reason = reason.when(differ, F.concat(F.lit("chosen over "), (F.col("n_values") - 1).cast("string"), F.lit(" other value(s): newest, then most trusted")))
    refs = F.transform("evidence", lambda e: e.source_ref)

    def warning(kind: str, message: Column, resolution: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), refs.alias("refs"), resolution.alias("resolution"))

    kept = F.concat(F.lit("The value "), "winner_value", F.lit(" of "), "winner_ref", F.lit(" stands; the others are cited for disclosure."))
    warned = F.when(agreed, warning("duplicate", duplicate_message(), F.lit("One item stands for all of them and cites each."))).when(differ, warning("conflict", conflict_message(), kept))
    found = joined.withColumn("winner", every[0]).select(
        "task_id", "rank", "score", F.when(reason.isNotNull(), F.concat("why", F.array(reason))).otherwise(F.col("why")).alias("why"),
        every.alias("evidence"), warned.alias("warning"), "fact_key", *[F.col(f"winner.{c}").alias(c) for c in ("source_ref", "fact_value", "observed_at", "confidence", *item)],
    )
    return found
