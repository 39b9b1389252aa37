"""Watching a table of sources: rules over the files of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts, rules
from ..sources.files import from_table

SOURCES = "path string, source string"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, source) of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(SOURCES).parquet(folder)


def file_rules(mods: DataFrame) -> DataFrame:
    """Findings that need nothing but a file itself: unused imports and complexity."""
    found = rules.unused_imports(mods, "error")
    return found.unionByName(rules.high_complexity(facts.functions(mods), "warn"))


def watch(stream: DataFrame, target: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] = file_rules, once: bool = False) -> StreamingQuery:
    """Append the findings of newly arrived sources to ``target`` as Parquet.

    Rules over the import graph need the whole corpus and are left to a batch run. A
    batch that is repeated after a failure overwrites its own folder.
    """
    def handle(batch: DataFrame, number: int) -> None:
        mods = facts.modules(from_table(batch, batch.path, batch.source)).persist()
        try:
            check(mods).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            mods.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
