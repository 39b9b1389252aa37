"""Corpus pipeline: five operators in a row over the table ``documents``.

Each stage gets what the one before kept, written as Parquet and read again, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithic.llm.common import documents, materialise
from lithic.llm.linededup import dedup_lines
from lithic.llm.mixing import mix_documents
from lithic.llm.packing import pack_sequence
from lithic.llm.quality import filter_documents, train
from lithic.llm.simhash import simhash_dedup

#: How often the mix may repeat a document.
MAX_REPEATS = 2.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, keeps."""
    return filter_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that have a near copy before them."""
    return dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, each at least once, in its order."""
    return mix_documents(docs, max_repeats=MAX_REPEATS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(window, doc_id, start, n_tokens): what each training window holds; its documents are neighbours in the mix."""
    return pack_sequence(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, MinHash, SimHash and token counts can't be put in SQL; tests hold the
#: stages against brute-force versions on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
