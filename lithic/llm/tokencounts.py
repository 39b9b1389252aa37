"""Token counts through a cache of digests.

The cache is a Parquet table (digest, version, n_tokens) to which each call
appends. A text is looked up by the digest of its normalised content and the
digest of the vocabulary file; what isn't there is encoded once for all its
copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, shared_dir, sliced
from .tokens import TOKENIZER, encoder, tokenizer_version

SCHEMA = "digest binary, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """Line ends as one newline character, no byte order mark at the start."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(text.startswith("﻿"), F.substring(text, 2, 2147483647)).otherwise(text)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) for one vocabulary; None where nothing is stored yet.

    Two writers at once may store a digest twice, with the same count.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(where)):
        return None
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/batch=*").where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(enc.counts(batch.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return count


def append_misses(keyed: DataFrame, cache: str, tokenizer: str = TOKENIZER) -> None:
    """Count the texts of ``keyed`` (digest, text) that the cache lacks, and store them.

    Each task first drops the copies among its own rows, so a text that a third of all
    rows hold moves once a task; then each digest is encoded once. A lost executor
    repeats its task. A reader during the write may see part of a batch, whose counts
    are right; what it lacks it counts itself.
    """
    spark, version = keyed.sparkSession, tokenizer_version(tokenizer)
    known = read_cache(spark, cache, version)
    miss = keyed.where("digest is not null")
    if known is not None:
        miss = miss.join(known.select("digest"), "digest", "left_anti")
    rows = miss.dropDuplicates(["digest"]).select("digest", "text").mapInArrow(_counter(tokenizer), "digest binary, n_tokens long")
    rows = rows.select("digest", F.lit(version).alias("version"), "n_tokens")
    rows.write.parquet(f"{cache}/batch={uuid.uuid4().hex}")


def token_counts(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, by way of the cache at ``cache``.

    ``n_tokens`` counts the ids of the whole normalised text: line ends become
    ``\\n`` and a byte order mark at the start goes.

    * A NULL text has a NULL count, an empty one 0.
    * NULL and repeated doc_ids, and repeated rows, are kept as they are.
    * Texts that are equal after normalisation are encoded once, however many
      rows have them and however long they are.
    * An empty table gives no rows and stores a batch without any.
    * Other columns are ignored, whatever their names.
    """
    text = normalised(F.col("text").cast("string"))
    keyed = only(docs, "doc_id", "text").select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    append_misses(keyed.select("digest", "text"), cache, tokenizer)
    known = read_cache(docs.sparkSession, cache, tokenizer_version(tokenizer))
    return keyed.select("doc_id", "digest").join(known, "digest", "left").select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the cache starts empty in the shared folder."""
    return token_counts(documents(spark, sf_dir), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
