"""Flat files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file named by path or URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class AtomicFile:
    """A file that appears under its name only when complete, so that a task tried again, or
    run twice at once, leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.tmp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def listing(spark, folder: str, pattern: str):
    """(path, name, length) of the files; Spark lists them and reads no content."""
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def spread(rows, at_most: int = 100_000):
    """Few small rows that stand for much work each (files, blocks), one or a few a task; an
    adaptive plan would put them all in one."""
    return rows.repartition(max(1, min(at_most, rows.count())))


def size_of(folder: str, name: str) -> int:
    """Bytes of a file, -1 if there is none."""
    f, base = filesystem(folder)
    info = f.get_file_info(f"{base}/{name}")
    return info.size if info.type == fs.FileType.File else -1


def by_key(df, key: str, folder: str) -> str:
    """Write ``df`` to ``folder``, the rows of each ``key`` apart, for the task that needs them."""
    df.repartition(key).sortWithinPartitions(key).write.option("compression", "zstd").partitionBy(key).parquet(folder)
    return folder


def of_key(folder: str, key: str, value: int) -> pa.Table | None:
    """The rows written for one key; None if there are none."""
    where, base = filesystem(folder)
    files = where.get_file_info(fs.FileSelector(f"{base}/{key}={value}", allow_not_found=True))
    paths = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(".parquet"))
    tables = [pq.ParquetFile(where.open_input_file(p)).read() for p in paths]
    return pa.concat_tables(tables) if tables else None
