"""Readers of the four kinds of input, with fixed schemas, and writers."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evipack.sources import folder as folder_files

RECORD = "doc_id string, title string, summary string, key_metrics array<string>, organizations_norm array<string>, people array<string>, technologies array<string>"
NOTE = "id string, channel string, author string, sent_at string, scope string, text string, facts array<struct<key:string,value:string>>"
GOLDEN = "id string, category string, query string, expected_action string, expected_doc_ids array<string>, expected_keywords array<string>"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): one text file per document, named by its id; line ends become \\n. As in Spark's file sources, files without
    a byte are passed over, so an empty document has no row (it would give no item either). The folder is listed by a task and the driver
    holds no list of its files, but for file systems and patterns that only Spark's own source can read."""
    if folder_files.reachable(folder):
        return folder_files.read_files(spark, folder).select("doc_id", F.regexp_replace(F.col("body").cast("string"), r"\r\n?", "\n").alias("text"))
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    encoded = F.regexp_replace("_metadata.file_name", r"\+", "%2B")  # names come as parts of a URI, in which a plus is no blank
    name = F.regexp_extract(F.url_decode(encoded), r"(?s)^(.*)\.txt$", 1)
    return rows.select(name.alias("doc_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record lines; of lines with one doc_id the last stays."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.schema(RECORD).json(path).withColumn("place", place)
    last = Window.partitionBy("doc_id").orderBy(F.col("place").desc())
    return rows.withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn", "place")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTE).json(path).withColumn("sent_at", F.to_timestamp_ntz("sent_at"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def read_hashes(spark: SparkSession, store: str) -> DataFrame:
    """Key and hash of the stored items; the other columns are not read."""
    return spark.read.parquet(store).select("source_ref", "content_hash")


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").partitionBy("scope").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_package(found, folder: str) -> None:
    """The long form of packages: heads, items, evidence and warnings, each as a table."""
    for name in ("heads", "items", "evidence", "warnings"):
        getattr(found, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of stored packages by name."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("heads", "items", "evidence", "warnings")}
