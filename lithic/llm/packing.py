"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Pieces are dealt into groups of about ``GROUP``, by the hash of a row number or by
consecutive rows of the input's files, and each group is packed on its own: a partial partition is the sums of its windows; the two with the
largest differences (largest minus smallest sum) are merged, the largest sums of
one with the smallest of the other, until one is left. A group starts with the
fewest windows that its tokens need and gets another one whenever a window comes
out above the capacity.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, only, sliced
from .tokens import TOKENIZER, encoder

CAPACITY = 4096
GROUP = 1024


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Partition of the items into ``windows`` near-equal sums: (sum, items) of each.

    Windows without an item are left out. Partial partitions are kept as their
    non-zero sums, smallest first.
    """
    heap = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        low = sizes[k] if windows == 1 else 0
        heap.append((low - sizes[k], len(heap), [(sizes[k], [k])]))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0 and len(b) == 1:
            out = a
            insort(out, b[0])
        elif both <= 0:
            out = sorted(a + b)
        else:
            # beside zeros the larger sums stay as they are; of the `both` smallest of
            # each, the largest of one meets the smallest of the other
            pairs = zip(reversed(a[:both]), b[:both], strict=True)
            out = sorted([(x + y, p + q) for (x, p), (y, q) in pairs] + a[both:] + b[both:])
        low = out[0][0] if len(out) == windows else 0
        heapq.heappush(heap, (low - out[-1][0], serial, out))
        serial += 1
    return heap[0][2] if heap else []


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each window; no window holds more than ``capacity`` tokens."""
    full = [[k] for k, s in enumerate(sizes) if s == capacity]
    rest = [k for k, s in enumerate(sizes) if s < capacity]
    if not rest:
        return full
    own = [sizes[k] for k in rest]
    windows = -(-sum(own) // capacity)
    while True:
        parts = differencing(own, windows)
        if max(s for s, _ in parts) <= capacity:
            return full + [[rest[k] for k in sorted(items)] for _, items in parts]
        windows += 1


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(enc.counts(texts), pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return count


def _packer(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("n_tokens", "ascending")])
        group = table.column("grp")[0].as_py()
        parts = pack_group(table.column("n_tokens").to_pylist(), capacity)
        where = np.zeros(table.num_rows, np.int64)
        for w, items in enumerate(parts):
            where[items] = w
        window = pa.array((np.int64(group) << np.int64(24)) + where)
        return pa.table({"window": window, "doc_id": table.column("doc_id"), "start": table.column("start"), "n_tokens": table.column("n_tokens")})

    return pack


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Windows of ``lengths`` (doc_id, n_tokens, and perhaps run); see :func:`pack_windows`.

    Rows of one ``run`` (long) are packed together. Without runs, rows are dealt by
    the hash of their number in the written table, so rows that look alike spread.
    """
    lengths = lengths.where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id())
    lengths = materialise(lengths, "pack")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long")))
    pieces = lengths.select("*", starts.alias("start"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("start")).alias("size")
    if "run" in lengths.columns:
        # two runs of one number would be one group, which is as good
        groups = max(1, -(-lengths.count() // group))
        dealt = pieces.select(F.expr("pmod(run, 1L << 39)").alias("grp"), "doc_id", "start", size)
    else:
        groups = max(1, -(-pieces.count() // group))
        where = F.pmod(F.xxhash64("row", "start"), F.lit(groups).cast("long"))
        dealt = pieces.select(where.alias("grp"), "doc_id", "start", size)
    # by number, lest few bytes of much work are merged into few tasks
    tasks = max(1, min(groups, int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.withColumnRenamed("size", "n_tokens").repartition(tasks, "grp")
    return dealt.groupBy("grp").applyInArrow(_packer(capacity), "window long, doc_id long, start long, n_tokens long")


def pack_windows(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(window, doc_id, start, n_tokens): what each training window holds.

    A row is tokens ``start`` to ``start + n_tokens`` of a document. Every token
    of every row of ``docs`` is in one window, no window holds more than
    ``capacity``, and a document is cut only every ``capacity`` tokens.

    * NULL and empty texts have no tokens and are in no window.
    * NULL and repeated doc_ids and repeated rows are packed row by row, and spread
      over the groups however many there are. ``doc_id`` must be a number.
    * Very long texts give as many full windows as they fill and one piece.
    * Equal sizes are taken by doc_id. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    return _windows(only(docs, "doc_id", "text"), capacity, tokenizer, group)


def pack_sequence(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """:func:`pack_windows` of a table read from files, by runs of ``group`` consecutive rows.

    What is near in the files, as :func:`mixing.mix_documents` orders them, is in windows
    of one group; all else holds as for :func:`pack_windows`.
    """
    file = docs.metadataColumn("_metadata")
    run = F.xxhash64(file["file_path"], F.floor(file["row_index"] / F.lit(group)))
    at = [docs.columns.index(c) for c in ("doc_id", "text")]
    named = docs.select("*", run.alias("__run")).toDF(*[f"c{k}" for k in range(len(docs.columns))], "run")
    return _windows(named.select(F.col(f"c{at[0]}").alias("doc_id"), "run", F.col(f"c{at[1]}").alias("text")), capacity, tokenizer, group)


def _windows(rows: DataFrame, capacity: int, tokenizer: str, group: int) -> DataFrame:
    rows = rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    run = ", run long" if "run" in rows.columns else ""
    return pack_lengths(rows.mapInArrow(_counter(tokenizer), f"doc_id long{run}, n_tokens long"), capacity, group)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows over all documents."""
    return pack_windows(documents(spark, sf_dir))
