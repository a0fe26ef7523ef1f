"""Files as sources: external tables, literal texts, frozen copies, and what tells that they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reader by suffix of a path.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".txt": "text", ".orc": "orc"}


class UnknownFormat(ValueError):
    """No reader is known for a path."""


def format_of(path: str) -> str:
    """The reader for a path, by its suffix without case; an unknown one is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, kind in FORMATS.items():
        if name.endswith(suffix):
            return kind
    raise UnknownFormat(f"no reader for {path}")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path, in place, by the format of its suffix."""
    reader = spark.read
    kind = format_of(path)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",")
    return reader.format(kind).load(path)


def literal(spark: SparkSession, text: str) -> DataFrame:
    """One row that holds a text, verbatim."""
    return spark.createDataFrame([(text,)], "value string")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, length) of the files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of the files below a path: SHA-256 of their contents, on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def stat(spark: SparkSession, path: str) -> tuple[bool, int, int]:
    """(exists, newest change in milliseconds, bytes) of a file or folder, from file names alone; metadata (names that start with ``_`` or ``.``) doesn't count."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        return False, 0, 0
    newest, size, todo = 0, 0, [place]
    while todo:
        for status in fs.listStatus(todo.pop()):
            name = status.getPath().getName()
            if status.isDirectory():
                if not name.startswith(("_", ".")):
                    todo.append(status.getPath())
            elif not name.startswith(("_", ".")) or status.getPath().equals(place):
                newest, size = max(newest, status.getModificationTime()), size + status.getLen()
    return True, newest, size


def change_token(spark: SparkSession, path: str) -> str:
    """A token of an external source that changes when its files do (by time and size)."""
    exists, newest, size = stat(spark, path)
    return f"{newest}:{size}" if exists else "missing"
