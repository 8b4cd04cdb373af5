"""The driver's tables as the library's inputs: the item store of all sources, tasks, facts, messages and records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evipack.operators import hooks, incremental, lexical, vectors
from evipack.plans import resolve as rs
from evipack.schema import DEFAULTS
from evipack.sources import normalize
from evipack.stored import stored

AS_OF = "2024-07-01 00:00:00"
ENTITY = "the company"
#: Boilerplate of this corpus: its license sentences.
RULES = [
    r"Released under the MIT License\.",
    r"Licensed under the Apache License, Version 2\.0\.",
    r"Licensed under CC BY-NC 4\.0\.",
    r"This work is licensed under the GNU General Public License, version 3\.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_third(n, values):
    return F.when(n % 3 == 0, values[0]).when(n % 3 == 1, values[1]).otherwise(values[2])


def documents(spark, sf_dir) -> DataFrame:
    """(doc_id, text): documents that begin with a day, a month, a year or no date at all, by id."""
    d = F.timestamp_add("DAY", (F.col("doc_id") % 1000).cast("int"), F.lit("2022-01-01 00:00:00").cast("timestamp_ntz"))
    k = F.col("doc_id") % 4
    dated = (
        F.when(k == 0, F.concat(F.lit("Bonn, "), F.date_format(d, "MMMM d, yyyy"), F.lit(". ")))
        .when(k == 1, F.concat(F.lit("In "), F.date_format(d, "MMMM yyyy"), F.lit(" it was reported. ")))
        .when(k == 2, F.concat(F.lit("The year "), F.date_format(d, "yyyy"), F.lit(" in review. ")))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(dated, F.coalesce("text", F.lit(""))).alias("text"))


def records(spark, sf_dir) -> DataFrame:
    """Labels as records of their documents."""
    quality, toxic = (F.concat(F.lit(f"{name} "), F.col(column).cast("string")) for name, column in (("quality", "quality"), ("toxicity", "toxic")))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id", F.lit(" rated")).alias("title"), F.concat(F.lit("It has "), quality, F.lit(" and "), toxic, F.lit(".")).alias("summary"),
        F.array(quality, toxic).alias("key_metrics"), F.array(F.lit("Rating desk")).alias("organizations_norm"), F.lit(None).cast("array<string>").alias("people"), none.alias("technologies"),
    )


def all_items(spark, sf_dir) -> DataFrame:
    """The rows of all sources: chunks of documents, records, facts of results tables, messages and the facts they tag."""
    recs, messages = records(spark, sf_dir), notes(spark, sf_dir)
    docs = normalize.dated(documents(spark, sf_dir))  # read and dated twice, for chunks and records, which costs less than storing the texts
    return normalize.all_items(
        normalize.press_releases(docs, recs.select("doc_id", "title"), RULES), normalize.records(recs, docs), normalize.financial_facts(table_texts(spark, sf_dir), ENTITY),
        normalize.internal_notes(messages), normalize.note_facts(messages, ENTITY),
    )


_held: dict[tuple[str, str, str], object] = {}


def once(spark, sf_dir: str, name: str, make):
    """What `make` gives, kept for the session: the item store and its index are made once and read by every query after that."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def items(spark, sf_dir) -> DataFrame:
    """The item store."""
    return once(spark, sf_dir, "items", lambda: stored(all_items(spark, sf_dir), "items"))


def items_index(spark, sf_dir) -> lexical.Index:
    """The text index of the item store, which no upsert changes."""
    return once(spark, sf_dir, "index", lambda: index_of(items(spark, sf_dir)))


def conversation(conv_id):
    return F.concat(F.lit("conv"), F.lpad(conv_id.cast("string"), 5, "0"))


def tasks(spark, sf_dir) -> DataFrame:
    """Benchmark passages, and questions about each conversation and a year, as tasks with scopes and budgets by id."""
    scopes = [F.array(*[F.lit(s) for s in ("public", "internal", "private")[:k]]) for k in (1, 2, 3)]
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.coalesce("text", F.lit("")).alias("task"))
    conv = F.col("conv_id")
    asked = F.concat(conversation(conv), F.when(conv % 3 == 1, " FY2023").when(conv % 3 == 2, " fy2030").otherwise(""))
    talks = table(spark, sf_dir, "conversations").select("conv_id").distinct().select((conv + 1_000_000).alias("task_id"), asked.alias("task"))
    return passages.unionByName(talks).select(
        "task_id", "task", _by_third(F.col("task_id"), scopes).alias("scopes"), (300 + (F.col("task_id") * 97) % 3000).cast("int").alias("budget_tokens"), F.lit(AS_OF).cast("timestamp_ntz").alias("as_of")
    )


def index_of(store: DataFrame) -> lexical.Index:
    """The index of a table that stays as it is."""
    maps = stored(lexical.item_maps(store), "term-maps")
    posts = lexical.postings_of(maps)
    return lexical.Index(posts, stored(lexical.idf(store, posts), "weights"), maps, store.count())


def found(index: lexical.Index, wanted: DataFrame) -> DataFrame:
    """Scored candidates of all tasks, stored, as the loose list, the strict one and the coverage of hits all come from them."""
    return stored(lexical.searched(index, wanted), "candidates")


def searched(asked: DataFrame, index: lexical.Index) -> tuple[DataFrame, DataFrame]:
    """The terms of the tasks and what they find."""
    wanted = stored(lexical.task_terms(asked, index.weights), "task-terms")
    return wanted, found(index, wanted)


def matches(spark, sf_dir) -> DataFrame:
    """Every match of every task."""
    index = items_index(spark, sf_dir)
    return lexical.matches(index.postings, lexical.task_terms(tasks(spark, sf_dir), index.weights))


def hits(spark, sf_dir) -> DataFrame:
    asked = stored(tasks(spark, sf_dir), "tasks")
    matched = searched(asked, items_index(spark, sf_dir))[1]
    return rs.hits_of(asked, items(spark, sf_dir), rs.text_lists(matched, "lexical", 0), matched)


def resolved(spark, sf_dir, asked: DataFrame | None = None) -> rs.Package:
    """Packages of all tasks from the lexical channel."""
    asked = stored(tasks(spark, sf_dir) if asked is None else asked, "tasks")
    store, matched = items(spark, sf_dir), searched(asked, items_index(spark, sf_dir))[1]
    return rs.resolve(asked, store, rs.hits_of(asked, store, rs.text_lists(matched, "lexical", 0), matched))


# ---- several channels -------------------------------------------------------------------------------------------

CHANNELS = ("lexical", "dense", "lexical_ctx", "dense_ctx")
#: Configurations to compare: a name, the channels that are fused, and whether their hits are reranked.
CONFIGURATIONS = (
    ("lexical", ("lexical",), False), ("lexical, dense", ("lexical", "dense"), False), ("lexical, dense, reranked", ("lexical", "dense"), True),
    ("contextual", ("lexical_ctx", "dense_ctx"), False), ("contextual, reranked", ("lexical_ctx", "dense_ctx"), True),
)


def extras(spark, sf_dir) -> DataFrame:
    """(source_ref, scope, context_note, embedding, embedding_ctx) of all chunks, beside the store and not within a copy of it: a chunk's
    note is its document's first sentence; the first chunk of document d has the embedding of that number, and with its note that of d + 1,
    which falls back to the plain one."""
    notes_of = hooks.write_notes(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_hash"), F.col("text").alias("document"), F.lit("").alias("chunk")))
    notes_of = notes_of.select(F.col("chunk_hash").alias("noted"), F.col("note").alias("context_note"))
    chunks = items(spark, sf_dir).where("source = 'press_release'").select("source_ref", "scope", "doc_id")
    rows = chunks.join(notes_of, F.col("doc_id") == F.col("noted"), "left").drop("noted")
    side = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    number = F.when(F.col("source_ref").endswith("#0"), F.col("doc_id").try_cast("long"))
    rows = rows.withColumns({"number": number, "next_number": number + 1}).drop("doc_id")
    rows = rows.join(side.withColumnRenamed("vec_id", "number"), "number", "left")
    rows = rows.join(side.select(F.col("vec_id").alias("next_number"), F.col("embedding").alias("embedding_ctx")), "next_number", "left")
    rows = incremental.with_fallback_vector(rows.drop("number", "next_number").withColumn("embedding_ctx", F.when(F.col("embedding").isNotNull(), F.col("embedding_ctx"))))
    return stored(rows, "extras")


def noted(store: DataFrame, beside: DataFrame) -> DataFrame:
    """What is indexed of items with their notes; items that can have none stay where they are."""
    rows, chunk = store.select("source_ref", "scope", "title", "content", "source"), F.col("source").eqNullSafe("press_release")
    own = rows.where(chunk).join(beside.select("source_ref", "context_note"), "source_ref", "left")
    return own.withColumn("content", F.concat_ws(" ", "context_note", "content")).drop("context_note").unionByName(rows.where(~chunk).withColumn("content", F.concat_ws(" ", "content"))).drop("source")


def asked_vectors(spark, sf_dir, asked: DataFrame) -> DataFrame:
    """Tasks with the embedding of their number, where there is one."""
    side = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("task_id"), "embedding")
    return asked.join(side, "task_id")


def vector_list(asked: DataFrame, beside: DataFrame, column: str, channel: str, number: int) -> DataFrame:
    queries = asked.select(F.col("task_id").cast("string").alias("source_ref"), F.col("embedding").alias(column), "scopes")
    top = vectors.cosine_top_k(queries, beside, DEFAULTS.top_k, "source_ref", column, query_scopes="scopes", item_scope="scope")
    return top.select(F.col("query_id").cast("long").alias("task_id"), F.col("item_id").alias("source_ref"), F.lit(channel).alias("channel"), F.lit(number).alias("list_no"), "rank")


def channel_lists(spark, sf_dir, beside: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of all channels (0, 1 lexical; 2 dense; 3, 4 lexical with notes; 5 dense with notes), and what the plain terms of a
    task cover in every item on one of them."""
    index = items_index(spark, sf_dir)
    (wanted, plain), (_, contextual) = searched(asked, index), searched(asked, index_of(noted(items(spark, sf_dir), beside)))
    vectored = asked_vectors(spark, sf_dir, asked)
    every = rs.text_lists(plain, "lexical", 0).unionByName(rs.text_lists(contextual, "lexical_ctx", 3))
    every = every.unionByName(vector_list(vectored, beside, "embedding", "dense", 2)).unionByName(vector_list(vectored, beside, "embedding_ctx", "dense_ctx", 5))
    every = stored(every, "channel-lists")
    return every, stored(lexical.scored(every.select("task_id", "source_ref").distinct(), index, wanted), "covered")


def configured(rows: DataFrame) -> DataFrame:
    """Each row once per configuration (its number in `config`), with a task id of its own for each."""
    n = len(CONFIGURATIONS)
    each = rows.withColumn("config", F.explode(F.array(*[F.lit(k) for k in range(n)])))
    return each.withColumn("task_id", F.col("task_id") * n + F.col("config"))


def scored(fused: DataFrame) -> DataFrame:
    """Scores 0 to 10 by task and item, with gaps; a stand-in for a model, kept in SQL's reach."""
    size = F.length("source_ref")
    return fused.where(size % 4 != 0).select("task_id", "source_ref", ((F.col("task_id") + size) % 11).cast("double").alias("rerank_score"))


def compared(spark, sf_dir) -> tuple[rs.Package, DataFrame]:
    """Packages of every configuration, all in one plan: a task of each configuration is a task of its own."""
    store, beside = items(spark, sf_dir), extras(spark, sf_dir)
    asked = stored(tasks(spark, sf_dir), "tasks")
    every, plain = channel_lists(spark, sf_dir, beside, asked)
    wanted = F.lit(False)
    for k, (_, channels, _) in enumerate(CONFIGURATIONS):
        wanted = wanted | ((F.col("config") == k) & F.col("channel").isin(*channels))
    ranked = stored(configured(every).where(wanted).drop("config"), "configured-lists")
    each = stored(configured(asked).drop("config"), "configured-tasks")
    reranked = [k for k, (_, _, rerank) in enumerate(CONFIGURATIONS) if rerank]
    scores = scored(ranked.where((F.col("task_id") % len(CONFIGURATIONS)).isin(*reranked)).select("task_id", "source_ref").distinct())
    covered = configured(plain).drop("config")
    return rs.resolve(each, store, rs.hits_of(each, store, ranked, covered, scores, beside.select("source_ref", "context_note"))), each


def facts(spark, sf_dir, agreeing: bool = False) -> DataFrame:
    """Events as facts: a key per user and type; all values of even users alike if `agreeing`."""
    value = F.floor(F.col("value") * 100).cast("long").cast("string")
    value = F.when(F.col("user_id") % 2 == 0, "0").otherwise(value) if agreeing else value
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("event/"), F.col("event_id")).alias("source_ref"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("fact_key"),
        value.alias("fact_value"), F.col("ts").cast("timestamp_ntz").alias("observed_at"),
        F.when(F.col("event_id") % 3 == 0, 0.85).otherwise(0.6).alias("confidence"), _by_third(F.col("event_id"), ("public", "internal", "private")).alias("scope"),
    )


def notes(spark, sf_dir) -> DataFrame:
    """Conversation turns as messages that tag two facts each: a length, on which the turns of a year differ, and a status, on
    which they agree."""
    conv, turn = F.col("conv_id"), F.col("turn")
    sent = F.timestamp_add("HOUR", (conv % 1000 + 24 * turn).cast("int"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    ident, author = F.concat_ws("-", conv.cast("string"), turn.cast("string")), conversation(conv)
    values = {"length": F.length(F.coalesce("text", F.lit(""))).cast("string"), "status": F.lit("open")}
    tagged = F.array(*[F.struct(F.concat(author, F.lit(f" {m}|FY "), (2022 + turn % 2).cast("string")).alias("key"), v.alias("value")) for m, v in values.items()])
    return table(spark, sf_dir, "conversations").select(
        ident.alias("id"), F.coalesce("role", F.lit("none")).alias("channel"), author.alias("author"), sent.alias("sent_at"),
        F.when(F.col("role") == "user", "public").when(F.col("role") == "assistant", "internal").otherwise("private").alias("scope"),
        F.coalesce("text", F.lit("")).alias("text"), tagged.alias("facts"),
    )


def table_texts(spark, sf_dir) -> DataFrame:
    """A results table as text for each supplier nation: per brand the quantities of even and odd years and a change."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    even = F.year("l_shipdate") % 2 == 0
    sums = rows.groupBy("s_nationkey", "p_brand").agg(
        F.sum(F.when(even, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("even"), F.sum(F.when(~even, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("odd")
    )
    line = F.concat_ws("\n", "p_brand", F.concat(F.col("even").cast("string"), F.lit(".0")), F.concat(F.col("odd").cast("string"), F.lit(".0")), F.lit("5.0"))
    body = sums.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("p_brand", line.alias("line")))).alias("own"))
    head = F.lit("Results for Q4 2001.\nFY 2000\nFY 2001\nChange\n%\nmillions of €\n")
    return body.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("doc_id"), F.concat(head, F.array_join(F.transform("own", lambda x: x.line), "\n")).alias("text"))
