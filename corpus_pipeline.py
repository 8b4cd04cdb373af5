"""Training-data pipeline over the documents table: each stage's rows are written and read again by the next one."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evipack.llm import bpe, exact_dedup, mixing, quality, simhash
from evipack.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the forest, fitted on labels of sf_dir, and the base rules keep. Null ids and texts are judged as rows of their own (a
    null text fails the base rules); repeated rows are kept or go together; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, by digest, so repeated or null ids drop no other text. All columns stay."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near fingerprints. All columns stay; texts without words are near copies of each other."""
    return simhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, whole, as often as it takes them; documents without words are not taken. All columns stay."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of doc_id, n_tokens, ids_sha256 and decoded_sha256 per row of `docs`; a null text counts as empty."""
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mix),
    ("bpe", tokens),
]
#: Fingerprints, the forest and the draw have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
