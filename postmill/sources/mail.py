"""Mail sources: folders of files, bytes at hand, and streams of arriving files."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "mail_id string, path string, content binary"
_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_mail(spark: SparkSession, *paths: str, pattern: str = "*.eml", recursive: bool = True) -> DataFrame:
    """(mail_id, path, content) of the files that match pattern; one file is one row, mail_id its path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    return files.select(F.col("path").alias("mail_id"), "path", "content")


def read_one(path: str) -> tuple[bytes | None, str | None]:
    """(content, None) of a file, or (None, why it cannot be read)."""
    try:
        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
        with system.open_input_stream(name, compression=None) as stream:
            return stream.read(), None
    except Exception as error:  # whatever a file system raises
        return None, f"cannot be read: {type(error).__name__}"


def read_mail_tolerant(spark: SparkSession, *paths: str, pattern: str = "*.eml", recursive: bool = True) -> DataFrame:
    """The rows of read_mail with read_error: why a file cannot be read, with a null content; other files go on.

    Spark lists the files and the executors open them one by one, so a file that is in
    the way costs a row and not the job. For file systems that pyarrow can open.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(list(paths))

    def opened(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content, problem = read_one(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path]), pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=["mail_id", "path", "content", "read_error"])

    return files.select("path").mapInArrow(opened, f"{COLUMNS}, read_error string")


def from_bytes(spark: SparkSession, mails: Iterable[bytes]) -> DataFrame:
    """(mail_id, path, content) of mails at hand, as from standard input; no bytes at all are an empty mail."""
    rows = [(f"stdin-{k}", None, bytearray(m)) for k, m in enumerate(mails)]
    return spark.createDataFrame(rows, COLUMNS)


def read_mail_stream(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """The same rows as files arrive: an extension, for Structured Streaming."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("mail_id"), "path", "content")


def existing_notes(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, markdown) of the notes in folders; a note that is not UTF-8 has a null markdown."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(list(folders))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("markdown"))


def existing_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none where it cannot be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
