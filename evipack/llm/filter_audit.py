"""How filters interact: what each step of each order of a set of filters keeps and removes, and Shapley values.

A state is the set of filters that were applied; the states form a subset lattice, and an order of filters is a path
through it. What a step removes depends on its state only, so 2^k states stand for all k! orders. Path counting forward
tells how many orders reach a state, backward how many ways lead on from it; an edge's removals, weighted by both counts, add up to
the removals of its filter over all orders. The steps of single orders are read from the same edges.

Documents reach the lattice as counts by the set of filters that they fail, so its work does not grow with them.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evipack.llm.scratch import written

BLANKS = r"[\x20\x09-\x0D]+"
#: All orders are listed, so that their number is bounded.
MOST = 8


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def _few_distinct(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def _capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long")


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Failure conditions by letter, from the text and its words.
CONDITIONS = {"A": _few_words, "B": _few_distinct, "C": _capitals, "D": _symbols}
#: The letter of the filter that drops copies of texts with a smaller doc_id.
COPIES = "E"


def edges(names: str, before: tuple[tuple[str, str], ...] = ()) -> list[tuple[int, int, int]]:
    """(state, filter, paths) of each edge that an order may take: `paths` counts the orders that do, as the orders that reach the state
    times the ways on from the next one. A pair in `before` demands that its first filter comes before its second."""
    n = len(names)
    if not 0 < n <= MOST or len(set(names)) < n:
        raise ValueError(f"1 to {MOST} different filters")
    needs = [sum(1 << names.index(a) for a, b in before if b == name) for name in names]
    steps = [(s, f, s | 1 << f) for s in range(1 << n) for f in range(n) if not s >> f & 1 and not needs[f] & ~s]
    reach, leave = [1] + [0] * ((1 << n) - 1), [0] * ((1 << n) - 1) + [1]
    for s, _, t in steps:
        reach[t] += reach[s]
    for s, _, t in reversed(steps):
        leave[s] += leave[t]
    return [(s, f, reach[s] * leave[t]) for s, f, t in steps if reach[s] * leave[t]]


def orders(names: str, before: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, int, int, int]]:
    """(order, step, state, filter) of each step of each order."""
    found = []
    for order in permutations(names):
        if all(order.index(a) < order.index(b) for a, b in before):
            state = 0
            for k, name in enumerate(order):
                f = names.index(name)
                found.append(("".join(order), k + 1, state, f))
                state |= 1 << f
    return found


def _failures(docs: DataFrame, conditions: dict, part: str) -> DataFrame:
    """(doc_id, part, mask, digest) of each row, stored: texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    mask = F.lit(0)
    for k, failed in enumerate(conditions.values()):
        mask = mask + F.when(failed(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    return written(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-failures")


def failure_counts(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, copies: bool = True, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the set of conditions that they fail, a bit each; the bit after the last
    condition is for copies of a text with a smaller doc_id, anywhere in the table. Stored; at most 2^k rows for each part.

    Equal rows are counted before they move. Equal texts fail alike, so that of a group of copies only counts by part, and
    the smallest doc_id, meet in one task.
    """
    rows = _failures(docs, conditions, part)
    keys = ("doc_id", "part", "mask", "digest")
    alike = rows.where("doc_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    each = alike.join(known, "doc_id", "left").select(*keys, "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    zero = F.lit(0).cast("long")
    none = rows.where("doc_id IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, "n", zero.alias("good"), zero.alias("toxic"))
    groups = each.unionByName(none).groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(zero)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("first"),
    )
    if copies:
        leads = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part and mask of a text
        kept = lambda c: F.when(leads, F.col(f"first.{c}")).otherwise(zero)
        groups = groups.withColumns({"own_n": kept("n") + F.col("nameless"), "own_good": kept("good"), "own_toxic": kept("toxic")})
        own = F.struct("mask", F.col("own_n").alias("n"), F.col("own_good").alias("good"), F.col("own_toxic").alias("toxic"))
        rest = F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), *[(F.col(c) - F.col(f"own_{c}")).alias(c) for c in ("n", "good", "toxic")])
        groups = groups.select("part", F.inline(F.array(own, rest)))
    counts = groups.where("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return written(counts, "audit-counts")


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, copies: str | None = COPIES, part: str = "lang", before: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row per part, filter_order and step (from 1): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `docs` has doc_id, text and the column `part`; other columns are ignored. `conditions` maps a letter to a failure condition of a text
    and its words; `copies` is the letter of a last filter that drops rows whose text has a row with a smaller doc_id anywhere in the table
    (None: no such filter). `before` demands an order of pairs, and leaves out the orders that break it. `labels` has doc_id, quality, toxic.

    Per step and part: kept and removed rows, `redundant` ones that fail its filter but went earlier, `unique_fails` that fail this filter
    only, and removed rows with quality or toxic 1. shapley adds up what the filter removes over all orders.

    A null text counts as empty, a null part as an empty string. A null doc_id is no copy and makes none, and has no labels. Rows
    repeated with doc_id and text are counted each; none of them is a copy of another. A doc_id with several labels counts as good or
    toxic if one of them says so. An empty table gives an empty result.
    """
    names = "".join(conditions) + (copies or "")
    counts = failure_counts(docs, labels, conditions, copies is not None, part)
    lattice = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(p).cast("long").alias("paths")) for s, f, p in edges(names, before)])
    each = counts.select("*", F.inline(lattice))
    alive, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("f"))) != 0
    total = lambda met, c="n": F.sum(F.when(met, F.col(c)).otherwise(F.lit(0).cast("long")))
    found = each.groupBy("part", "state", "f", "paths").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.call_function("shiftleft", F.lit(1), F.col("f"))).alias("unique_fails"), total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost"),
    )
    found = found.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "f")))
    steps = docs.sparkSession.createDataFrame(orders(names, before), "filter_order string, step int, state int, f int")
    told = found.join(F.broadcast(steps), ["state", "f"])  # as many rows as the filters have orders and steps, whatever the data
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
