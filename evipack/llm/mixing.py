"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, on built-in functions only.

Documents are dealt by hash to blocks of their source. Every source has an exact quota of words: whole passes over all its blocks, and a rest,
which is a draw without replacement: its blocks in a permuted order until the rest is used up, the last one in part. So every source has an
exact quota of block draws. The output shards are common to all sources, and are the leaves of a tree: each node splits its vector of
quotas between its two children, by successive hypergeometric draws, one source after the other, so that each child has its share of all
blocks and the leaves add up to the quotas. A shard then gets the next blocks of each source in that source's permuted order, as many as its
quota says, so that no two shards share a draw; its rows are shuffled by hash.

Only sums by source and block reach the tree, at most `BLOCKS` and one per source; a source of any size is spread over its blocks.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evipack.llm.scratch import written
from evipack.llm.skew import shielded

WEIGHTS, TOTAL, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words that a block holds on average, and rows, where many have few words or none; larger blocks if that made more than BLOCKS.
BLOCK_WORDS, BLOCK_ROWS, BLOCKS = 1 << 12, 1 << 12, 1 << 20
#: Block draws of a shard, about.
SHARD_BLOCKS = 128
#: Blocks of a packed row, and draws up to which the packed rows are broadcast (a few tens of MB). Draws of BLOCKS blocks are fewer.
PACK, PACKED = 256, 8 * BLOCKS
#: Bits of a packed draw: its shard, its pass, and whether it takes the whole block.
PASS_BITS = 20
WORD = r"[^\x20\x09-\x0D]+"
#: Draws invert the exact distribution up to this standard deviation and are normal beyond. Quotas of at most CAP * BLOCKS draws, of sources that
#: have no more blocks than their words ask for, have one of under 800, so that every draw of the tree is exact.
EXACT_SD = 4096.0


def uniform(*parts) -> Column:
    """A number in (0, 1) that only depends on `parts`."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """`sizes` (source, source_size; other columns come along) plus `target`: `total` times all sizes, shared by the weights of the sources in
    code-point order (null last, the weights repeating); a target stops at `cap` times its source's size and the
    excess goes to the others by weight. One row per source goes through these windows."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ceiling = F.lit(cap) * F.col("source_size")
    full = Window.orderBy(ceiling / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(total) * F.sum("source_size").over(everything) - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighted.withColumns({"level": level, "reach": ceiling / F.col("weight")})
    # The first source, by how soon it fills, whose level does not reach its ceiling sets the level for all behind it.
    settled = leveled.withColumn("settled", F.min(F.when(F.col("level") <= F.col("reach"), F.struct(F.col("reach"), F.col("level")))).over(everything))
    return settled.select(
        *sizes.columns,
        F.when(F.col("settled").isNull() | (F.col("reach") < F.col("settled.reach")), ceiling).otherwise(F.least(ceiling, F.col("weight") * F.col("settled.level"))).alias("target"),
    )


def _drawn(white: Column, black: Column, take: Column, *seed) -> Column:
    """How many of `take` draws without replacement are white: an integer, given `white` and `black` (longs)."""
    every = white.cast("double") + black.cast("double")
    lowest = F.greatest(F.lit(0).cast("long"), take - black)
    highest = F.least(white, take)
    mean = F.when(every > 0, take.cast("double") * (white.cast("double") / every)).otherwise(F.lit(0.0))
    spread = F.when(every > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (black / every) * ((every - take) / (every - 1))))).otherwise(F.lit(0.0))
    normal = F.sqrt(-2 * F.log(uniform(*seed, F.lit("a")))) * F.cos(2 * 3.141592653589793 * uniform(*seed, F.lit("b")))
    rounded = F.round(mean + spread * normal).cast("long")

    first = F.greatest(lowest, F.floor(mean - 8 * spread - 2).cast("long"))
    last = F.least(highest, F.ceil(mean + 8 * spread + 2).cast("long"))
    steps = F.when(spread <= EXACT_SD, F.sequence(first, F.greatest(first, last))).otherwise(F.array(last))

    def ratio(k: Column) -> Column:  # chance of k + 1 over that of k
        return ((white - k).cast("double") * (take - k).cast("double")) / ((k + 1).cast("double") * (black - take + k + 1).cast("double"))

    def walk(state: Column, k: Column) -> Column:
        return F.struct((state.p * ratio(k)).alias("p"), (state.total + state.p).alias("total"))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("total"))
    total = F.aggregate(steps, start, walk, lambda s: s.total)
    goal = uniform(*seed, F.lit("c")) * total
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"), goal.alias("goal"))

    def pick(state: Column, k: Column) -> Column:
        return F.struct(
            (state.p * ratio(k)).alias("p"),
            (state.total + state.p).alias("total"),
            F.when((state.k < 0) & (state.total + state.p >= state.goal), k).otherwise(state.k).alias("k"),
            state.goal.alias("goal"),
        )

    exact = F.aggregate(steps, begin, pick, lambda s: F.when(s.k < 0, last).otherwise(s.k))
    return F.when(lowest >= highest, highest).when(spread > EXACT_SD, F.greatest(lowest, F.least(highest, rounded))).otherwise(exact)


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _mark(text: Column) -> Column:
    """Tells rows with one doc_id apart, and spreads those without any."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _block(doc_id: Column, mark: Column, fan: Column, seed: int) -> Column:
    return F.floor(uniform(F.lit(seed), F.lit("block"), doc_id, mark) * fan).cast("long")


def _turn(doc_id: Column, mark: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("turn"), doc_id, mark)


class Plan(NamedTuple):
    """A mix before its documents. `rows`: doc_id, source, size, mark of each row. `goal`, a row per source: source, number, source_size,
    target, passes, fan. `draws`, a row per block draw: number, block, pass, quota (words), words (of the block), shard. All are stored."""

    rows: DataFrame
    goal: DataFrame
    draws: DataFrame


def _blocked(rows: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """Rows with what their source has to give, and their block. Sources are a small side, which Spark broadcasts if it is."""
    joined = rows.join(goal.withColumnRenamed("source", "of source"), F.col("source").eqNullSafe(F.col("of source")))
    return joined.withColumn("block", _block(F.col("doc_id"), F.col("mark"), F.col("fan"), seed)).drop("of source", "fan")


def _split(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """Nodes (first, k, quotas: an array with the block draws of each source) of one level to those of the next."""
    half = F.floor(F.col("k") / 2)
    every = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    kind = "struct<take:bigint,rest:bigint,out:array<bigint>>"

    def draw(state: Column, x: Column) -> Column:
        own = _drawn(x, state.rest - x, state.take, F.lit(seed), F.lit(level), F.col("first"), F.size(state.out))
        return F.transform(F.array(own), lambda d: F.struct((state.take - d).alias("take"), (state.rest - x).alias("rest"), F.array_append(state.out, d).alias("out")).cast(kind))[0]

    start = F.struct(F.floor(every * half / F.col("k")).cast("long").alias("take"), every.alias("rest"), F.array().cast("array<bigint>").alias("out")).cast(kind)
    parted = nodes.withColumn("left", F.when(F.col("k") > 1, F.aggregate("quotas", start, draw, lambda s: s.out)))
    lower = F.struct(F.col("first"), half.cast("long").alias("k"), F.col("left").alias("quotas"))
    upper = F.struct((F.col("first") + half).cast("long").alias("first"), (F.col("k") - half).cast("long").alias("k"), F.zip_with("quotas", "left", lambda q, d: q - d).alias("quotas"))
    whole = F.struct("first", "k", "quotas")
    return parted.select(F.inline(F.when(F.col("k") > 1, F.array(lower, upper)).otherwise(F.array(whole))))


def _shards_of(counts: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(number, seq, shard): the shard of each block draw, from the draws of each source (number from 0 without gaps, n)."""
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("number", "n"))), lambda x: x.n)
    root = written(counts.agg(quotas.alias("quotas")).select(F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("k"), "quotas"), "mix-root")  # one row
    k = max(1, -(-(root.select(F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)).first()[0] or 0) // shard_blocks))  # one number
    nodes = root.withColumn("k", F.lit(k).cast("long"))
    for level in range((k - 1).bit_length()):
        nodes = written(_split(nodes, level, seed), "mix-nodes")
    leaves = nodes.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("number", "n"))
    upto = F.sum("n").over(Window.partitionBy("number").orderBy("shard"))
    return leaves.withColumn("upto", upto).where("n > 0").select("number", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("seq"), "shard")


def _plan(docs: DataFrame, weights, total, cap, seed: int, block_words: int, block_rows: int, shard_blocks: int) -> Plan:
    rows = written(docs.select(F.col("doc_id").cast("long"), "source", _size(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark")), "mix-sizes")
    everything = rows.agg(F.sum("size"), F.count(F.lit(1))).first()  # two numbers
    words, many = max(block_words, (everything[0] or 0) // BLOCKS), max(block_rows, everything[1] // BLOCKS)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets(sizes, weights, total, cap).withColumn("passes", passes)
    rest = F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")
    fan = F.greatest(F.lit(1), F.ceil(F.col("source_size") / words), F.ceil(F.col("n_rows") / many)).cast("long")
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1  # a row per source, as in `targets`
    goal = written(goal.withColumns({"rest": F.greatest(F.lit(0).cast("long"), rest), "fan": fan, "number": number}).drop("n_rows"), "mix-targets")

    blocks = _blocked(rows, goal, seed).groupBy("number", "passes", "rest", "block").agg(F.sum("size").alias("words")).where("words > 0")
    turn = F.xxhash64(F.lit(seed), F.lit("draw"), F.col("number"), F.col("pass"), F.col("block"))
    each = written(blocks, "mix-blocks").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("turn", turn)
    permuted = Window.partitionBy("number").orderBy("pass", "turn", "block")
    earlier = F.sum("words").over(Window.partitionBy("number", "pass").orderBy("turn", "block")) - F.col("words")
    quota = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - earlier))
    drawn = each.withColumn("quota", quota).where("quota > 0").withColumn("seq", (F.row_number().over(permuted) - 1).cast("long"))
    drawn = written(drawn.select("number", "block", "pass", "quota", "words", "seq"), "mix-drawn")
    counts = goal.select("number").join(drawn.groupBy("number").agg(F.count(F.lit(1)).alias("n")), "number", "left").fillna(0, ["n"])
    return Plan(rows, goal, written(drawn.join(_shards_of(counts, shard_blocks, seed), ["number", "seq"]).drop("seq"), "mix-draws"))


def _by_block(draws: DataFrame) -> DataFrame:
    """(of number, of block, held): the draws of each block, no more than passes and a rest, as an array of pass, quota, words and shard."""
    held = F.array_sort(F.collect_list(F.struct("pass", "quota", "words", "shard"))).alias("held")
    return draws.groupBy(F.col("number").alias("of number"), F.col("block").alias("of block")).agg(held)


def _packed(draws: DataFrame) -> DataFrame:
    """(of number, of pack, packed): the draws of PACK blocks that follow each other, as one array that a block finds its own in by its place.
    A draw is one long, so that the blocks of any input, no more than about BLOCKS, can go to the texts and not the texts to them."""
    code = F.shiftleft(F.col("shard"), PASS_BITS + 1).bitwiseOR(F.shiftleft(F.col("pass").cast("long"), 1)).bitwiseOR((F.col("quota") == F.col("words")).cast("long"))
    place, pack = F.pmod("block", F.lit(PACK)).cast("int"), F.floor(F.col("block") / PACK).cast("long")
    held = draws.groupBy(F.col("number").alias("of number"), pack.alias("of pack"), place.alias("place")).agg(F.collect_list(code).alias("codes"))
    rows = held.groupBy("of number", "of pack").agg(F.map_from_entries(F.collect_list(F.struct("place", "codes"))).alias("by place"))
    packed = rows.select("of number", "of pack", F.transform(F.sequence(F.lit(0), F.lit(PACK - 1)), lambda k: F.try_element_at("by place", k)).alias("packed"))
    packed = written(packed, "mix-packed")
    return F.broadcast(packed) if draws.count() <= PACKED else packed


def _parts(plan: Plan, seed: int) -> DataFrame:
    """Rows of the blocks that are drawn in part, in their order, with `part`: the words that the last draw takes of each."""
    cut = plan.draws.where("quota < words").select(F.col("number").alias("of number"), F.col("block").alias("of block"), "quota")
    rows = _blocked(plan.rows, plan.goal, seed).withColumn("turn", _turn(F.col("doc_id"), F.col("mark"), seed))
    rows = rows.join(cut, (F.col("number") == F.col("of number")) & (F.col("block") == F.col("of block")))
    order = Window.partitionBy("number", "block").orderBy("turn", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    return rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - before))).drop("of number", "of block")


def mix(
    docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 42, block_words: int = BLOCK_WORDS, block_rows: int = BLOCK_ROWS, shard_blocks: int = SHARD_BLOCKS
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source; other columns are ignored): doc_id, size, source_size, target,
    taken, shards (an array: one for each time that it is taken, wholly or in part), block, source.

    size counts the `[^\\x20\\x09-\\x0D]+` of the text (null: none). Each source's `taken` adds up to its rounded
    target exactly; no row gives more than `cap` times its size, and all orders and draws are by hash,
    so reruns agree. A null source is a source of its own, last in the order; null ids do no harm. Rows repeated with one
    doc_id are taken one after the other. Empty texts give nothing; an empty table gives an empty result.
    """
    plan = _plan(docs, weights, total, cap, seed, block_words, block_rows, shard_blocks)
    rows = _blocked(plan.rows, plan.goal, seed)
    rows = rows.join(_by_block(plan.draws), (F.col("number") == F.col("of number")) & (F.col("block") == F.col("of block")), "left")
    held = F.when(F.col("size") > 0, F.col("held"))
    in_part = F.coalesce(F.exists(held, lambda d: d.quota < d.words), F.lit(False))
    shown = lambda taken, shards: [F.col(c) for c in ("doc_id", "size", "source_size", "target")] + [taken.cast("long").alias("taken"), shards.alias("shards"), F.col("block"), F.col("source")]
    none = F.array().cast("array<bigint>")
    whole = rows.where(~in_part).select(*shown(F.col("size") * F.coalesce(F.size(held), F.lit(0)), F.coalesce(F.transform(held, lambda d: d.shard), none)))
    cut = _parts(plan, seed).where("size > 0").join(_by_block(plan.draws), (F.col("number") == F.col("of number")) & (F.col("block") == F.col("of block")))
    kept = F.filter("held", lambda d: (d.quota == d.words) | (F.col("part") > 0))
    return whole.unionByName(cut.select(*shown(F.col("passes") * F.col("size") + F.col("part"), F.transform(kept, lambda d: d.shard))))


def mixed_shards(
    docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 42, block_words: int = BLOCK_WORDS, block_rows: int = BLOCK_ROWS, shard_blocks: int = SHARD_BLOCKS,
    columns: tuple[str, str] = ("shard", "place"),
) -> DataFrame:
    """The mix itself: each row of `docs` as often as the mix takes it whole (none, once or more), with all its columns, its shard and
    the hash that orders the shard's rows (under the names in `columns`, which give way to none of the documents'). Texts move once, to their
    shards, where the rows lie in the order of that hash: the draws come to them packed, by broadcast.

    The row at which a source's quota ends comes whole if at least half of it is taken; rows alike in id, text and source are
    taken alike. Null ids, texts and sources, repeated rows and empty tables are taken as in `mix`.
    """
    plan = _plan(docs, weights, total, cap, seed, block_words, block_rows, shard_blocks)
    alike = _parts(plan, seed).where("part > 0").groupBy("number", "block", "turn", "doc_id", "mark").agg(F.sum("part").alias("part"), F.sum("size").alias("size"))
    last = F.max(F.struct(F.struct("turn", "doc_id", "mark").alias("place"), "part", "size")).alias("last")  # null ids come first, as in the draw
    ends = alike.groupBy(F.col("number").alias("end number"), F.col("block").alias("end block")).agg(last)
    ends = written(ends.select("end number", "end block", F.col("last.place").alias("end place"), (2 * F.col("last.part") >= F.col("last.size")).alias("end whole")), "mix-ends")
    own, back = shielded(docs)
    each = docs.select(*own, F.col("doc_id").cast("long").alias("id of row"), F.col("source").alias("source of row"), (_size(F.col("text")) > 0).alias("row has words"), _mark(F.col("text")).alias("mark of row"))
    side = plan.goal.select(F.col("source").alias("goal of"), F.col("number").alias("goal number"), F.col("fan").alias("goal fan"))
    each = each.where("`row has words`").join(side, F.col("source of row").eqNullSafe(F.col("goal of")))
    each = each.withColumn("block of row", _block(F.col("id of row"), F.col("mark of row"), F.col("goal fan"), seed))
    each = each.withColumn("pack of row", F.floor(F.col("block of row") / PACK).cast("long"))
    each = each.join(_packed(plan.draws), (F.col("goal number") == F.col("of number")) & (F.col("pack of row") == F.col("of pack")))
    each = each.withColumn("held", F.get("packed", F.pmod("block of row", F.lit(PACK)).cast("int"))).where("held IS NOT NULL")
    each = each.join(ends, (F.col("goal number") == F.col("end number")) & (F.col("block of row") == F.col("end block")), "left")
    here = F.struct(_turn(F.col("id of row"), F.col("mark of row"), seed).alias("turn"), F.col("id of row").alias("doc_id"), F.col("mark of row").alias("mark"))
    in_part = F.coalesce(here < F.col("end place"), F.lit(False)) | ((here == F.col("end place")) & F.col("end whole"))
    kept = F.filter("held", lambda d: (d.bitwiseAND(F.lit(1).cast("long")) == 1) | F.coalesce(in_part, F.lit(False)))
    turn = F.shiftright("draw of row", 1).bitwiseAND(F.lit((1 << PASS_BITS) - 1).cast("long"))
    place = F.xxhash64(F.lit(seed), F.lit("place"), "id of row", "mark of row", turn)
    rows = each.select(*[c for c in each.columns if c.startswith("own ")], "id of row", "mark of row", F.explode(kept).alias("draw of row"))
    rows = rows.withColumns({"shard of row": F.shiftright("draw of row", PASS_BITS + 1), "place of row": place})
    dealt = rows.repartition("shard of row").sortWithinPartitions("shard of row", "place of row")
    return dealt.select(*back, F.col("shard of row").alias(columns[0]), F.col("place of row").alias(columns[1]))


def mixed_documents(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of mixed_shards with the columns of `docs` alone, shard by shard."""
    found = mixed_shards(docs, *args, **kwargs, columns=("shard of mix", "place in mix"))
    return found.drop("shard of mix", "place in mix")
