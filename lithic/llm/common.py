"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- shared files
def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) is a folder made here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lithic-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs re-reading a file, not
    recomputing the plan that made it. :func:`discard` deletes the file. The
    shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later plan reads."""
    for table in tables:
        if path := getattr(table, "_written", None):
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -------------------------------------------------------------------- columns
def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns of ``df``, by their exact names, whatever the others are called."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[F.col(f"c{k}").alias(n) for k, n in zip(places, names, strict=True)])


def shielded(df: DataFrame, names: Iterable[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change(df)``, which keeps the columns, with all but ``names`` out of its way."""
    columns = df.columns
    first = {n: columns.index(n) for n in names if n in columns}
    inner = df.toDF(*[c if first.get(c) == k else f"extra{k}" for k, c in enumerate(columns)])
    return change(inner).toDF(*columns)


# ------------------------------------------------------------------- row keys
def with_text_hash(docs: DataFrame, name: str = "__h") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(F.col("text")))


def collapse_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``__h`` (hash of the text), each (doc_id, text) once.

    Rows that repeat both doc_id and text are one document; the row that stays
    is the one with the smallest hash over all columns. Rows that share only
    the doc_id stay apart, told from each other by ``__h``.
    """
    keyed = with_text_hash(docs)
    twice = keyed.groupBy("doc_id", "__h").count().where("count > 1").limit(1)
    if not twice.take(1):
        return keyed
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if _hashable(docs, c)])
    order = W.partitionBy("doc_id", "__h").orderBy(whole)
    return keyed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _hashable(df: DataFrame, name: str) -> bool:
    return "map" not in df.schema[name].dataType.simpleString()


# ----------------------------------------------------------- text in numpy
def sliced(batches: Iterator, rows: int = 1024) -> Iterator:
    """The batches in slices: a worker then holds that many texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``limit`` at most.

    An item above the limit is a range of its own, so nothing is cut.
    """
    start, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if k >= start:
        yield start, k + 1


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a 0, and where each starts."""
    joined = "\0".join(texts) + "\0"
    arr = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1], out=starts[1:])
    return arr, starts


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix), on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n``."""
    if len(_STATE.get("pw", ())) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.ones(1, np.uint64)
            step = base
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step & MASK64
            out.append(p)
        _STATE["pw"], _STATE["ipw"] = out
    return _STATE["pw"], _STATE["ipw"]


def prefix_sums(arr: np.ndarray) -> np.ndarray:
    """Sums for ``span_hash``: polynomial over the code points, modulo 2^64."""
    pw, _ = _powers(len(arr) + 1)
    x = arr.astype(np.uint64)
    x += np.uint64(0x632BE59BD9B4E019)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= pw[: len(arr)]
    out = np.empty(len(arr) + 1, np.uint64)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of code points start..end-1; equal spans, equal hashes."""
    _, ipw = _powers(len(sums))
    return mix64((sums[end] - sums[start]) * ipw[start])


def word_table() -> np.ndarray:
    """For every code point: is it a word character (letter, mark, digit, _)?"""
    if "word" not in _STATE:
        import regex

        table = np.zeros(0x110000, bool)
        chars = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
        found = regex.findall(r"\w", chars)
        table[[ord(c) for c in found]] = True
        _STATE["word"] = table
    return _STATE["word"]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every lower-case word: begin, end, index of its text; and the hash sums."""
    lowered = [t.lower() for t in texts]
    arr, starts = codepoints(lowered)
    is_word = word_table()[np.minimum(arr, 0x10FFFF)]
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return begin, end, np.searchsorted(starts, begin, "right") - 1, prefix_sums(arr)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-case word, and the index of the text it is in."""
    begin, end, where, sums = word_spans(texts)
    return span_hash(sums, begin, end), where


# ----------------------------------------------------- distributed union-find
def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (a, b).

    Union-find by alternating large-star and small-star rounds: each hooks
    every node to the smallest node seen near it, so that trees flatten in a
    logarithmic number of rounds. Every round is one aggregation by node and is
    written to the shared folder. ``component`` is the smallest node of its
    component; nodes without an edge aren't listed. NULL ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    e = materialise(e, tag)
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), "m")
        last, e = e, materialise(small.where("a <> m").select("a", F.col("m").alias("b")).distinct(), tag)
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
