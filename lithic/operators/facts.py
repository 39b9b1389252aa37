"""The parse and token passes, and the flat tables under the nested module rows."""

from __future__ import annotations

import gc
from collections.abc import Collection, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.python_source import KEYWORDS, Memo, module_facts, path_facts, source_facts, source_tokens
from ..schemas import MODULES, TOKENS


#: A corpus of more bytes a task than this is parsed where it is read.
SPREAD_BYTES = 1 << 25


def _spread(corpus: DataFrame) -> DataFrame:
    """A small corpus over all tasks by path, a large one as it comes.

    Parsing costs far more than reading, so the few partitions of a small table would
    leave tasks idle; moving it is cheap. A large one has splits enough, and isn't moved.
    """
    spark, rows = corpus.sparkSession, corpus.select("path", "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(tasks, "path") if size <= tasks * SPREAD_BYTES else rows


#: Rows a worker turns into facts at a time.
BATCH = 256
#: About as many bytes of facts are handed on at a time.
OUT_BYTES = 1 << 23


def _sources(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
        if path is not None and content is not None:
            yield path, content.decode("utf-8", "replace")


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@contextmanager
def _without_collector() -> Iterator[None]:
    """Trees have no cycles; looking for some takes as long as parsing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def modules(corpus: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """One row of ``MODULES`` for every file that parses; others are left out.

    The one pass over the sources: every table below is an explode of its result.
    ``wanted`` names the columns that are made, by default all. A text that a task has
    seen before isn't parsed again; only what follows from the path is made for each file.
    """
    kinds = StructType([f for f in StructType.fromDDL(MODULES).fields if wanted is None or f.name in wanted])
    schema = to_arrow_schema(kinds)
    of_path = [f for f in schema if f.name in path_facts("")]
    of_text = pa.schema([f for f in schema if f.name not in path_facts("")])

    def rows(batch: pa.RecordBatch, texts: Memo, blocks: Memo) -> Iterator[pa.RecordBatch]:
        coded = batch.column("content").dictionary_encode()
        if len(coded.dictionary) > BATCH:
            for k in range(0, len(batch), BATCH):
                yield from rows(batch.slice(k, BATCH), texts, blocks)
            return
        made = []
        for content in coded.dictionary.to_pylist():
            if content not in texts:
                with _without_collector():
                    texts.keep(content, source_facts(content.decode("utf-8", "replace"), wanted, blocks))
            made.append(texts[content])
        codes = coded.indices.to_numpy()
        parsed = np.array([m is not None for m in made], bool)[codes]
        at = (np.cumsum([m is not None for m in made]) - 1)[codes[parsed]]
        text = pa.RecordBatch.from_pylist([m for m in made if m is not None], of_text) if of_text else None
        paths = batch.column("path").filter(pa.array(parsed)).to_pylist()
        step = len(batch) if text is None else max(1, min(len(batch), OUT_BYTES * len(text) // max(1, text.nbytes)))
        for k in range(0, len(paths), step):
            own = [path_facts(p, wanted) for p in paths[k : k + step]]
            columns = {f.name: pa.array([p[f.name] for p in own], f.type) for f in of_path}
            if text is not None:
                taken = text.take(pa.array(at[k : k + step]))
                columns |= {f.name: taken.column(f.name) for f in of_text}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, blocks = Memo(), Memo()
        for batch in batches:
            there = pc.and_(batch.column("path").is_valid(), batch.column("content").is_valid())
            yield from rows(batch.filter(there), texts, blocks)

    return _spread(corpus).mapInArrow(parse, kinds)


def parse_errors(corpus: DataFrame) -> DataFrame:
    """(path) of the files that don't parse."""

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"path": [p for p, s in _sources(b) if module_facts(p, s, ()) is None]}, pa.schema([("path", pa.string())]))

    return corpus.select("path", "content").mapInArrow(failed, "path string")


def tokens(corpus: DataFrame) -> DataFrame:
    """One row of ``TOKENS`` a file: kinds, texts and lines of its tokens."""
    schema = to_arrow_schema(StructType.fromDDL(TOKENS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for path, source in _sources(b):
                    kinds, texts, lines = source_tokens(source)
                    yield {"path": path, "kinds": kinds, "texts": texts, "lines": lines}

        return _batched(rows(), schema)

    return _spread(corpus).mapInArrow(scan, TOKENS)


def source_lines(corpus: DataFrame) -> DataFrame:
    """(path, line, text): lines of the sources, numbered from 1."""
    text = F.decode("content", "UTF-8")
    return _spread(corpus).select("path", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def normalised_values(rows: DataFrame, mode: str) -> DataFrame:
    """``rows`` of TOKENS with ``values``: the texts under a clone mode.

    strict keeps the text; mild and semantic replace names, strings and numbers;
    weak replaces operators too. Other modes are strict.
    """
    swaps = {"NAME": "$ID", "STRING": "$STR", "NUMBER": "$NUM"}
    if mode == "weak":
        swaps["OP"] = "$OP"
    if mode not in ("mild", "semantic", "weak"):
        return rows.withColumn("values", F.col("texts"))
    words = F.array(*[F.lit(k) for k in sorted(KEYWORDS)])

    def swap(text, kind):
        out = F.when((kind == "NAME") & ~F.array_contains(words, text), F.lit(swaps["NAME"]))
        for name, value in list(swaps.items())[1:]:
            out = out.when(kind == name, F.lit(value))
        return out.otherwise(text)

    return rows.withColumn("values", F.zip_with("texts", "kinds", swap))


# ------------------------------------------------------------------ flat tables
#: Columns of ``modules`` that :func:`functions` and :func:`calls` read.
FUNCTION_FACTS = ("path", "is_test", "is_conftest", "line_count", "functions")
CALL_FACTS = ("path", "is_test", "is_conftest", "calls")


def imports(mods: DataFrame) -> DataFrame:
    """One row an import: path, import_id and the fields of IMPORT."""
    return mods.select("path", F.posexplode("imports").alias("import_id", "i")).select("path", "import_id", "i.*")


def exports(mods: DataFrame) -> DataFrame:
    return mods.select("path", F.posexplode("exports").alias("export_id", "e")).select("path", "export_id", "e.*")


def functions(mods: DataFrame) -> DataFrame:
    """One row a function, with what the rules ask of its module."""
    flags = ("path", "is_test", "is_conftest", "line_count")
    return mods.select(*flags, F.posexplode("functions").alias("function_id", "f")).select(*flags, "function_id", "f.*")


def calls(mods: DataFrame) -> DataFrame:
    flags = ("path", "is_test", "is_conftest")
    return mods.select(*flags, F.posexplode("calls").alias("call_id", "c")).select(*flags, "call_id", "c.*")
