"""Corpora: rows (path, content, size) from a folder of Python files or from any table."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_hidden, is_ignored

CORPUS = "path string, content binary, size long"


def _uri(root: Path | str) -> str:
    return str(root) if "://" in str(root) else Path(root).resolve().as_uri()


def list_tree(spark: SparkSession, root: Path | str, ignore: list[str] | None = None) -> DataFrame:
    """(path, size) of every ``*.py`` below ``root``, hidden and ignored ones left out.

    Spark's own file sources pass over names with a leading underscore, and with them
    over every ``__init__.py``; so the folder is listed here. Large corpora should come
    as a table (:func:`from_table`) instead of one file a module.
    """
    fs, base = pafs.FileSystem.from_uri(_uri(root))
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    prefix = base.rstrip("/") + "/"
    rows = [(i.path.removeprefix(prefix), i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(".py")]
    listed = spark.createDataFrame(rows, "path string, size long")
    return listed.where(~is_hidden(F.col("path")) & ~is_ignored(F.col("path"), ignore or []))


def read_tree(spark: SparkSession, root: Path | str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content, size) of the listed files; paths are relative to ``root``.

    The files are read by the tasks, after all path filters. One that can't be read
    is left out.
    """
    uri = _uri(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [content], "size": [len(content)]}, schema)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return list_tree(spark, root, ignore).select("path").repartition(tasks, "path").mapInArrow(read, CORPUS)


def from_table(df: DataFrame, path: Column, source: Column) -> DataFrame:
    """(path, content, size) of any table that holds sources as text."""
    return df.select(path.alias("path"), F.encode(source, "UTF-8").alias("content"), F.octet_length(source).cast("long").alias("size"))
