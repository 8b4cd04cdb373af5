"""Connected components of a link table: hooking to the smallest neighbour, and pointer jumping until roots are stable."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evipack.llm.scratch import written
from evipack.llm.skew import join_groups


def _to_roots(hooks: DataFrame) -> DataFrame:
    """(u, p, n) with p the root of the tree that u hooks into: each jump halves the way, so jumps grow with its logarithm."""
    while True:
        inner = hooks.where("u <> p").select(F.col("u").alias("p"), F.col("p").alias("above"))
        jumps = written(hooks.groupBy("p").agg(F.count(F.lit(1)).alias("size")).join(inner, "p"), "cc-jumps")
        if jumps.isEmpty():
            return hooks
        hooks = written(join_groups(hooks, jumps, "p", "size", "left").select("u", F.coalesce("above", "p").alias("p"), "n"), "cc-hooks")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b; longs) that has a link to another: root is the smallest node reachable.

    Each round every node hooks to its smallest neighbour, all nodes jump to the roots of the trees that this makes, and
    the links are rewritten to those roots; links inside one tree vanish. A tree has two nodes at least, so each round
    halves the nodes that are left, and rounds and jumps grow with logarithms, whatever the shape. The minimum combines
    before the shuffle and nodes with very many links are joined apart, so there is no hot group. Repeated links and
    links of a node with itself count once and not at all; an empty table gives an empty result.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc-links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "v").alias("p"), "n")
        hooks = _to_roots(written(hooks, "cc-hooks"))
        if first:
            roots, first = hooks.select(F.col("u").alias("node"), F.col("p").alias("root")), False
        else:
            sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
            moved = written(hooks.select(F.col("u").alias("root"), "p").join(sizes, "root"), "cc-moves")
            roots = written(join_groups(roots, moved, "root", "size", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        for x in "ab":
            edges = join_groups(edges, hooks.select(F.col("u").alias(x), F.col("p").alias(f"p{x}"), "n"), x, "n")
            edges = written(edges, "cc-ends") if x == "a" else edges
        edges = written(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "cc-links")
    return roots
