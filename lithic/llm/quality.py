"""Quality classifier: a generalised additive model with pairwise interactions.

Two such models are fitted to the labels, one for quality and one for toxicity.
Cyclic boosting visits one feature after the other with a tree of two cuts at
most and adds what it finds to that feature's lookup table; then the pairs of
features with the largest gain get tables of their own in the same way. To score
a document is to bin its features and add up table entries.

Features are counts over the whole text and hits of lists of words and word stems that are
learned from the labelled documents too: one half of the sample gives the lists, the
other half fits the tables, so a list's hits aren't known from its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, codepoints, documents, materialise, only, shielded, sliced, span_hash, word_spans

#: Labelled documents that the models are fitted to at most, taken by hash.
SAMPLE = 16384
BINS = 32
PAIR_BINS = 8
PAIRS = 10
CYCLES = 60
RATE = 0.15
LEAF = 8
#: Words in a list at most, and the least root of a word's likelihood ratio: a
#: chance of 6e-7, so that of the words of a sample hardly one is listed by luck.
LEXICON = 1024
SIGNIFICANCE = 5.0
THRESHOLD = 0.5
CHUNK = 1 << 17
_CACHE: dict = {}

_KINDS = ["lower", "upper", "digit", "space", "newline", "bar", "bang", "symbol", "stop", "other"]
FEATURES = [
    "log_chars", *[f"{k}_share" for k in _KINDS], "word_length", "log_words", "distinct_share", "repeat_share",
    "top_share", "line_length", "short_line_share", "poor_hits", "good_hits", "toxic_hits",
]
#: Characters of a word's beginnings that are terms of their own.
STEMS = (4, 5, 6, 7)
LISTS = ["poor", "good", "toxic"]


# ------------------------------------------------------------------- features
def _kinds() -> np.ndarray:
    if "kinds" not in _CACHE:
        import regex

        table = np.full(0x110000, _KINDS.index("other"), np.uint8)
        chars = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in (("lower", r"[\p{L}\p{M}]"), ("upper", r"\p{Lu}"), ("digit", r"\p{N}"), ("space", r"\s"), ("symbol", r"\p{S}|[#%&*@\\^_~/<>{}\[\]]"), ("stop", r"[.,;:?'\"()\-]")):
            table[[ord(c) for c in regex.findall(pattern, chars)]] = _KINDS.index(kind)
        table[ord("\n")], table[ord("|")], table[ord("!")] = (_KINDS.index(k) for k in ("newline", "bar", "bang"))
        _CACHE["kinds"] = table
    return _CACHE["kinds"]


def _terms(begin: np.ndarray, end: np.ndarray, where: np.ndarray, sums: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all words, and of the stems of those that are longer; with their texts."""
    yield hashes, where
    for size in STEMS:
        own = np.flatnonzero(end - begin > size)
        yield span_hash(sums, begin[own], begin[own] + size) ^ np.uint64(size), where[own]


class Listed:
    """The word lists, ready to be looked up."""

    def __init__(self, lists: dict[str, np.ndarray]):
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists.values()]))
        self.of = np.stack([np.isin(self.all, lists[k]) for k in LISTS])
        self.maybe = np.zeros(1 << 16, bool)  # most words are told apart by their first bits
        self.maybe[(self.all >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, terms: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """For each list the distinct terms of each text that are in it."""
        pairs = [np.zeros(0, np.int64)]
        for hashes, where in terms:
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(self.all, hashes[some])
            found = self.all[np.minimum(at, len(self.all) - 1)] == hashes[some] if len(self.all) else np.zeros(0, bool)
            pairs.append(where[some[found]] * np.int64(len(self.all)) + at[found])
        pairs = np.unique(np.concatenate(pairs))
        text, term = pairs // max(1, len(self.all)), pairs % max(1, len(self.all))
        return np.stack([np.bincount(text[own[term]], minlength=n).astype(float) for own in self.of])


def features(texts: list[str], listed: Listed) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for lo, hi in batches_of(map(len, texts), CHUNK):
        own = texts[lo:hi]
        n = hi - lo
        arr, starts = codepoints(own)
        size = np.diff(starts, append=len(arr)) - 1
        text_of = np.repeat(np.arange(n), size + 1)
        kind = _kinds()[np.minimum(arr, 0x10FFFF)]
        counts = np.bincount(text_of * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
        counts[:, _KINDS.index("other")] -= 1  # the end mark
        chars = np.maximum(size, 1)[:, None]
        begin, end, where, sums = word_spans(own)
        hashes = span_hash(sums, begin, end)
        total = np.bincount(where, minlength=n)
        key = np.sort((where.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        run_text = (key[first] >> np.uint64(44)).astype(np.int64)
        run = np.diff(first, append=len(key))
        distinct = np.bincount(run_text, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, run_text, run)
        again = (hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])
        repeat = np.bincount(where[1:][again], minlength=n)
        ends = np.flatnonzero(arr == 10)
        ends = np.sort(np.concatenate([ends, starts + size]))
        length = np.diff(ends, prepend=-1) - 1
        line_text = text_of[ends]
        lines = np.bincount(line_text, minlength=n)
        short = np.bincount(line_text[length < 30], minlength=n)
        some = np.maximum(total, 1)
        letters = counts[:, 0] + counts[:, 1]
        cols = [
            np.log1p(size), *(counts / chars).T, letters / some, np.log1p(total), distinct / some, repeat / some,
            top / some, np.log1p(size / lines), short / lines, *listed.hits(_terms(begin, end, where, sums, hashes), n),
        ]
        out.append(np.stack(cols, axis=1))
    return np.concatenate(out)


# ---------------------------------------------------------------------- model
@dataclass
class Gam:
    """Bin edges of each feature, lookup tables of features and of pairs."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        if self.pairs:
            low = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.coarse)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[low[i], low[j]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut of a row of bins; no cut, gain 0."""
    gs, hs, ns = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    ok = (ns[:-1] >= LEAF) & (ns[-1] - ns[:-1] >= LEAF)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1]), -1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Value of each bin under the best tree of two cuts at most."""
    parts = [(0, len(g))]
    for _ in range(2):
        options = [(*_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a pair once."""
    sums = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n)]
    corner = [x[:-1, :-1] for x in sums]
    parts = []
    for x, c in zip(sums, corner, strict=True):
        right, below = x[:-1, -1:] - c, x[-1:, :-1] - c
        parts.append((c, right, below, x[-1, -1] - c - right - below))
    ok = np.all([p >= LEAF for p in parts[2]], axis=0)
    gain = sum(_gain(a, b) for a, b in zip(parts[0], parts[1], strict=True)) - _gain(sums[0][-1, -1], sums[1][-1, -1])
    gain = np.where(ok, gain, -1)
    if not gain.size or gain.max() <= 0:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    v = [_leaf(a[i, j], b[i, j]) for a, b in zip(parts[0], parts[1], strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of P(y = 1); with one class only it is a constant."""
    model = Gam()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(c, BINS) for c in x.T]
    model.coarse = [_edges(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    score = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    size = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    for _ in range(CYCLES):
        for k, b in enumerate(bins):
            g, h = slopes()
            m = len(model.tables[k])
            step = RATE * shallow_tree(np.bincount(b, g, m), np.bincount(b, h, m), size[k])
            model.tables[k] += step
            score += step[b]
    low = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T, strict=True)]
    width = [len(e) + 1 for e in model.coarse]

    def grid(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        return np.bincount(low[i] * width[j] + low[j], v, width[i] * width[j]).reshape(width[i], width[j]).astype(float)

    g, h = slopes()
    ranked = sorted(((-_quadrants(grid(i, j, g), grid(i, j, h), grid(i, j, None))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    counts = [grid(i, j, None) for i, j in model.pairs]
    for _ in range(CYCLES // 2):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h), counts[k])[1]
            model.pair_tables[k] += step
            score += step[low[i], low[j]]
    return model


# ------------------------------------------------------------------- training
def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column("text").to_pylist()
        for lo, hi in batches_of(map(len, texts), CHUNK):
            begin, end, where, sums = word_spans(texts[lo:hi])
            terms = list(_terms(begin, end, where, sums, span_hash(sums, begin, end)))
            hashes, where = (np.concatenate(x) for x in zip(*terms, strict=True))
            order = np.lexsort((hashes, where))
            hashes, where = hashes[order], where[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (where[1:] != where[:-1])
            row = pa.array(where[first] + lo)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), batch.column("quality").take(row), batch.column("toxic").take(row)], ["w", "quality", "toxic"])


def _lexicons(sample: DataFrame) -> dict[str, np.ndarray]:
    """Hashes of the words that are in more documents of a class than chance explains."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t")).first()
    n, q, t = (float(totals[c] or 0) for c in ("n", "q", "t"))
    found = sample.select("text", "quality", "toxic").mapInArrow(_word_rows, "w long, quality int, toxic int")
    found = found.groupBy("w").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("q"), F.sum("toxic").cast("double").alias("t"))
    out = {}
    for name, a, na in (("poor", F.expr("n - q"), n - q), ("good", F.col("q"), q), ("toxic", F.col("t"), t)):
        share = na / n if n else 0.0
        has, inside, outside = F.col("n"), F.lit(na), F.lit(n)
        # documents with and without the word, in the class and out of it, against independence
        cells = [(a, has * share), (has - a, has * (1 - share)), (inside - a, (outside - has) * share), (outside - has - inside + a, (outside - has) * (1 - share))]
        g = sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
        z = F.when(a > has * share, F.sqrt(F.greatest(2 * g, F.lit(0.0))))
        rows = found.select("w", z.alias("z")).where(F.col("z") > SIGNIFICANCE).orderBy(F.desc("z"), "w").limit(LEXICON).collect()
        out[name] = np.sort(np.array([r["w"] for r in rows], np.int64).view(np.uint64))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Word lists and the two models, from ``sample`` labelled documents at most.

    Of several labels for a document the worst counts; labels with a NULL are
    left out, as are those without a document with text.
    """
    each = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
    each = each.agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = only(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    # the sample is bounded, so it can be sent to every task
    rows = texts.join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))), "quality")
    listed = Listed(_lexicons(rows.where("half = 0")))
    cols = ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text").to_pylist(), listed)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column("quality"), batch.column("toxic")], names=[*[f"f{k}" for k in range(len(FEATURES))], "quality", "toxic"])

    got = rows.where("half = 1").select("text", "quality", "toxic").mapInArrow(measure, f"{cols}, quality int, toxic int").toArrow().to_pandas()
    got = got.sort_values(list(got.columns))  # the order of rows doesn't matter then
    x = got[[f"f{k}" for k in range(len(FEATURES))]].to_numpy(float)
    return {"listed": listed, "quality": fit(x, got["quality"].to_numpy(float)), "toxic": fit(x, got["toxic"].to_numpy(float))}


# -------------------------------------------------------------------- scoring
def _scorer(model: dict, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(0).to_pylist()
            x = features([t or "" for t in texts], model["listed"])
            none = np.array([not t or not t.strip() for t in texts], bool)
            quality = np.where(none, 0.0, model["quality"].probability(x))
            toxic = np.where(none, 0.0, model["toxic"].probability(x))
            keep = (quality >= THRESHOLD) & (toxic < THRESHOLD)
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(quality), pa.array(toxic), pa.array(keep)], names=names)

    return score


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, quality, toxicity, keep) of every row of ``docs``; no shuffle.

    ``quality`` and ``toxicity`` are probabilities; ``keep`` says that the first is
    ``THRESHOLD`` at least and the second below it.

    * NULL, empty and blank texts have nothing to learn from: 0, 0 and not kept.
    * NULL and repeated doc_ids and repeated rows are scored row by row; equal
      texts have equal scores.
    * Texts of any length are read whole. An empty table gives no rows. Without
      labels of both classes a model is the share of its labels.
    * Other columns are ignored, whatever their names.
    """
    rows = only(docs, "doc_id", "text").select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_scorer(model, ["doc_id", "quality", "toxicity", "keep"]), "doc_id long, quality double, toxicity double, keep boolean")


def filter_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns as they are."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scored = next(_scorer(model, ["quality", "toxicity", "keep"])(iter([pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])])))
            yield batch.filter(scored.column(2))

    at = docs.columns.index("text")
    return shielded(docs, ["text"], lambda inner: inner.mapInArrow(select, inner.schema))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, toxicity) of all documents that the classifier keeps."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).where("keep").drop("keep")
