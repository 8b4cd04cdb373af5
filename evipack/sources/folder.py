"""A folder with one text file per document, named by its id, written and read in parallel where the rows lie.

The writer is the one that Spark lacks: `format("document_folder")`. Spark's own sources read such a folder too, but hold a record of each
file on the driver; here one task lists the folder, and the names are a table that tasks of bounded size read their files by.
"""

import os
import posixpath
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from evipack.stored import stored

FORMAT = "document_folder"
#: Files that a task reads, names in a batch, and bytes of a batch of texts, about.
FILES, NAMES, BYTES = 1 << 12, 1 << 14, 1 << 24


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        files, folder = fs.FileSystem.from_uri(self.folder)
        files.create_dir(folder, recursive=True)
        for doc_id, text in iterator:
            if doc_id is None or doc_id != posixpath.basename(doc_id) or doc_id in ("", ".", "..") or "\0" in doc_id:
                raise ValueError(f"no file can have the name of document {doc_id!r}")
            with files.open_output_stream(f"{folder}/{doc_id}.txt") as out:  # the same file when a task runs again
                out.write((text or "").encode())
        return WriterCommitMessage()


class DocumentFolder(DataSource):
    """Option path: a folder that every executor reaches, as a URI or an absolute path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite or schema.names != ["doc_id", "text"]:
            raise ValueError("documents (doc_id, text) are added to a folder")
        return _Writer(self.options["path"])


def write_documents(docs: DataFrame, folder: str) -> None:
    """Each row of (doc_id, text) as the file `doc_id`.txt, byte for byte; a null text is an empty file. Ids are names of files as they are."""
    docs.sparkSession.dataSource.register(DocumentFolder)
    docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text").write.format(FORMAT).mode("append").save(folder)


def reachable(folder: str) -> bool:
    """Whether tasks can list the folder themselves; other file systems and patterns of paths are Spark's alone."""
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return not set(folder) & set("*?[]{}")


def _listed(folder: str):
    files, path = fs.FileSystem.from_uri(folder)
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(path) as entries:  # one by one: no list of all is held
            yield from (e.name for e in entries if e.name.endswith(".txt") and e.is_file())
    else:
        yield from (x.base_name for x in files.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.endswith(".txt"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, body): the bytes of each file `doc_id`.txt right in the folder that has any."""

    def names(batches):
        for _ in batches:
            for some in batched(_listed(folder), NAMES):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def bodies(batches):
        files, path = fs.FileSystem.from_uri(folder)
        own, held, size = [], [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{path}/{name}", compression=None) as source:
                    body = source.read()
                if body:
                    own.append(name.removesuffix(".txt"))
                    held.append(body)
                    size += len(body)
                if size >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(held, pa.binary())], ["doc_id", "body"])
                    own, held, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(held, pa.binary())], ["doc_id", "body"])

    found = stored(spark.range(0, 1, 1, 1).mapInArrow(names, "name string"), "document-names")
    return found.repartition(-(-found.count() // FILES) or 1).mapInArrow(bodies, "doc_id string, body binary")
