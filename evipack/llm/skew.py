"""Joins with a table of one row per key, where single keys may hold a large share of all rows.

Fewer than `HEAVY` keys can hold more than one part in `HEAVY` of the rows, whatever the data. Those few, if they have more than
`HEAVY` rows as well, are broadcast; the other keys shuffle, and none of them is more than that part of the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 1024


def _heavy(groups: DataFrame, size: str) -> Column:
    """Whether a key of `groups` is heavy: true for fewer than HEAVY of its rows."""
    total = groups.agg(F.sum(size)).first()[0] or 0  # one number
    return (F.col(size) > HEAVY) & (F.col(size) * HEAVY > F.lit(total))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """`rows` joined (inner or left) with `groups` on `key`, which is unique there and not null; `size` says how many rows
    have the key, and is left out of the result. Both frames are read twice, so they should be stored tables."""
    over = _heavy(groups, size)
    heavy, light = F.broadcast(groups.where(over).drop(size)), groups.where(~over).drop(size)
    others = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(others.join(light, key, how))


def join_suspects(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` left joined with `groups` on `key`, as above, where only rows with `suspect` can have a group.

    The other rows stay in their place, and so do those of heavy keys; only the rest shuffles. `suspect` and `size` are
    left out of the result."""
    over = _heavy(groups, size)
    heavy = F.broadcast(groups.where(over).drop(size).withColumn("of heavy key", F.lit(True)))
    light = groups.where(~over).drop(size)
    found = rows.join(heavy, key, "left")
    shuffled = F.col("suspect") & F.col("of heavy key").isNull()
    columns = [c for c in found.columns if c not in ("suspect", "of heavy key")]
    others = found.where(shuffled).select(*[c for c in rows.columns if c != "suspect"]).join(light, key, "left")
    return found.where(~shuffled).select(*columns).unionByName(others.select(*columns))


def shielded(docs: DataFrame) -> tuple[list, list]:
    """Columns of `docs` under names that clash with none, and the way back."""
    own = [F.col(f"`{c}`").alias(f"own {k}") for k, c in enumerate(docs.columns)]
    return own, [F.col(f"own {k}").alias(c) for k, c in enumerate(docs.columns)]
