"""Exact top-k of many queries against many items where nearly every pair could score: items in parts, queries in blocks.

Every item part meets every query block in one task of its own, both of bounded size, so that neither side is held whole anywhere,
and items are read once however many queries there are. A part gives at most k rows a query for the ranking over all parts.
Scores are compared as whole numbers of 1e-9, ties by item id.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a part and queries of a block, on average. A part is numbered in 16 bits within its keys.
PART, BLOCK = 1 << 15, 1 << 13
NUMBERS = 1 << 16
#: Items scored at a time within a part.
STEP = 512
UNIT = 1e9
NOTHING = np.int64(np.iinfo(np.int64).min)


def keys(scores: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """One whole number for a score and the number of an item: greater for a greater score, then for a smaller number."""
    return (np.rint(scores * UNIT).astype(np.int64) << 16) + (NUMBERS - 1 - numbers)


def better(held: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The greatest keys of each row in `held` and `fresh`, as many as `held` has columns, in no order."""
    k = held.shape[1]
    both = np.concatenate((held, fresh), axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


def seen(query_scopes: list, item_scopes: list) -> np.ndarray:
    """Which query may see which item: a null list sees nothing, and nobody sees an item without a scope."""
    kinds = sorted({s for s in item_scopes if s is not None})
    place = {s: n for n, s in enumerate(kinds)}
    own = np.array([place.get(s, len(kinds)) for s in item_scopes], np.int64)
    may = np.array([[*(s in set(q or ()) for s in kinds), False] for q in query_scopes], bool).reshape(len(query_scopes), len(kinds) + 1)
    return may[:, own]


def _pairs(queries: pa.Table, items: pa.Table, held: np.ndarray, names: tuple[str, ...], k: int) -> pa.Table:
    rows, columns = np.nonzero(held != NOTHING)
    best = held[rows, columns]
    taken = NUMBERS - 1 - (best & (NUMBERS - 1))
    found = [queries["id"].take(pa.array(rows)), items["id"].take(pa.array(taken)), pa.array((best >> 16) / UNIT), pa.array((columns // k).astype(np.int32))]
    return pa.table(found[: len(names)], list(names))


def best_pairs(queries: DataFrame, items: DataFrame, k: int, score: Callable, names: tuple[str, ...] = ("query_id", "item_id", "score"), part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score): for each query at least its k best items, as the parts found them.

    Both frames have `id` and what `score(queries, items, k)` needs: a function of two Arrow tables, the items in order of their
    id and fewer than 65,536, that gives an array of at least k keys for each query, NOTHING where there is none. It may give several
    lists of k keys beside each other; a fourth name is that of a column with the number of the list, from 0.
    """
    n_items, n_queries = items.count(), queries.count()
    parts, blocks = -(-n_items // part) or 1, -(-n_queries // block) or 1
    kinds = (queries.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString(), "double", "int")
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=False))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.withColumn("of block", of(blocks)).withColumn("of part", numbers(parts))
    right = items.withColumn("of part", of(parts)).withColumn("of block", numbers(blocks))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.sort_by("id").combine_chunks()
        if not asked.num_rows or not held.num_rows:
            return _pairs(asked, held, np.zeros((0, 0), np.int64), names, k)
        return pa.concat_tables([_pairs(asked, some, score(asked, some, k), names, k) for some in (held.slice(at, NUMBERS) for at in range(0, held.num_rows, NUMBERS))])

    each = left.groupBy("of part", "of block").cogroup(right.groupBy("of part", "of block"))
    return each.applyInArrow(run, schema)


def ranked(pairs: DataFrame, k: int, *order, query: str = "query_id") -> DataFrame:
    """The first k rows of each query, with `rank`."""
    turn = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return pairs.withColumn("rank", turn).where(F.col("rank") <= k)
