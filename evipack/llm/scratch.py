"""Tables written part-way through a job, in the folder that the cluster shares.

A written table cuts lineage, survives lost executors and gives later joins exact sizes. The folder is
`spark.checkpoint.dir` of the session; only a local session without that setting gets a folder of its own.
"""

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evipack-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and return it read again, with the same schema."""
    return written_parts([df], name)


def written_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema written one after the other as one table, so that no two of them need memory at once."""
    table = None
    for df in parts:
        if table is None:
            spark, schema, table = df.sparkSession, df.schema, f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(table)
    return spark.read.schema(schema).parquet(table)
