"""Mixing sources to target weights by temperature.

Source shares are raised to an exponent between 1 (as they are) and 0 (all
equal) that bisection finds for a target entropy or a repetition limit. The
normalised weights become token budgets, and each source fills its budget with
permutations of its documents, one an epoch. All budgets are cut into equally
many blocks, so every block has the target mix; within a block documents are
permuted once more.

Positions within a source are running token counts in the order of a hash. They
come from two aggregations, one over hash buckets and one within each bucket,
so no task ever sorts a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import collapse_repeats, documents, materialise, only, shielded

#: How often the rarest source's documents may be repeated.
MAX_REPEATS = 4.0
#: Tokens a block holds, about.
BLOCK_TOKENS = 1 << 20
STEPS = 60
DIGITS = 9
#: Exponents that one aggregation over the sources tries.
POINTS = 15
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


# ------------------------------------------------------------------ exponent
class _Shares:
    """What the exponent's targets ask of the sources; they stay where they are."""

    def __init__(self, sources: DataFrame):
        row = sources.agg(F.sum("tokens").alias("s"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.count("*").alias("n")).first()
        self.n, self.total, self.low, self.high = row["n"], float(row["s"] or 0), float(row["lo"] or 0), float(row["hi"] or 0)
        self.sources = sources

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sums over all sources of share^a and share^a ln share; one aggregation."""
        share = F.col("tokens") / F.lit(self.total)
        z = [F.sum(F.pow(share, F.lit(a))).alias(f"z{k}") for k, a in enumerate(exponents)]
        l = [F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{k}") for k, a in enumerate(exponents)]
        row = self.sources.agg(*z, *l).first()
        return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]

    def entropies(self, exponents: list[float]) -> list[float]:
        """Of the weights share^a / Z, in nats."""
        return [math.log(z) - a * l / z for a, (z, l) in zip(exponents, self.sums(exponents), strict=True)]

    def repeats(self, a: float) -> float:
        """Of the rarest source when the largest is used once."""
        return (self.high / self.low) ** (1 - a)

    def repeats_within(self, exponents: list[float], budget: float) -> list[float]:
        """Of the rarest source in a mix of ``budget`` tokens."""
        return [budget * (self.low / self.total) ** a / z / self.low for a, (z, _) in zip(exponents, self.sums(exponents), strict=True)]


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent for ``sources`` (tokens): the least one that meets the target, rounded up.

    Entropy and repeats both fall as the exponent grows. With ``target_entropy``
    the weights have that entropy; below what the shares have as they are the
    exponent is 1, above log(sources) it is 0. With ``max_repeats`` it is the
    least exponent for which no source is repeated more often, in a mix of
    ``budget`` tokens if there is one. A budget of more than ``max_repeats`` times
    all tokens can't keep to it: the exponent is then 1, which repeats all alike.

    Where the sources must be summed up for each exponent, ``POINTS`` exponents share
    an aggregation and the interval between two of them is cut on.
    """
    shares = _Shares(sources)
    if not shares.n or (shares.low == shares.high and (budget is None or target_entropy is not None)):
        return 1.0
    low, high = 0.0, 1.0
    if target_entropy is None and budget is None:
        if shares.repeats(0.0) <= max_repeats:
            return 0.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if shares.repeats(mid) > max_repeats else (low, mid)
    else:
        most = max_repeats if target_entropy is None else target_entropy
        values = shares.entropies if target_entropy is not None else lambda tried: shares.repeats_within(tried, budget)
        if values([0.0])[0] <= most:
            return 0.0
        while high - low > 0.1**DIGITS / 100:
            tried = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
            over = sum(v > most for v in values(tried))  # they fall, so the first ones
            low, high = tried[over - 1] if over else low, tried[over] if over < POINTS else high
    return math.ceil(high * 10**DIGITS) / 10**DIGITS


def source_budgets(sources: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, quota): tokens of each source and of its share in the mix.

    Without ``budget`` it is the least for which each source is used whole.
    """
    totals = sources.agg(F.sum("tokens").alias("s"), F.max("tokens").alias("hi")).first()
    if not totals["s"]:
        return sources.select("source", "tokens", F.lit(0).cast("long").alias("quota")).limit(0)
    if budget is None:
        # quota = tokens of the largest, times (share / largest share) ^ a
        quota = F.lit(float(totals["hi"])) * F.pow(F.col("tokens") / F.lit(float(totals["hi"])), F.lit(a))
    else:
        share = F.pow(F.col("tokens") / F.lit(float(totals["s"])), F.lit(a))
        z = sources.agg(F.sum(share).alias("z")).first()["z"]
        quota = F.lit(float(budget)) * share / F.lit(z)
    return sources.select("source", "tokens", F.floor(quota + 0.5).cast("long").alias("quota"))


# ----------------------------------------------------------------- permutations
def draw(sized: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """(key, __h, source, n_tokens, epoch, pos, quota): what fills each source's quota.

    ``sized`` has key (text), __h, source and n_tokens; ``pos`` is the token at which
    the document starts in its source's sequence of permutations.
    """
    rows = sized.join(quotas, "source")
    last = F.greatest(F.ceil(F.col("quota") / F.col("tokens")), F.lit(1)).cast("int") - 1
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("key")))
    rows = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    rows = materialise(rows, "mix")
    bucket = W.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("n").over(bucket), F.lit(0)).alias("before"))
    within = W.partitionBy("source", "epoch", "bucket").orderBy("order", "n_tokens", "__h").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.join(sums, ["source", "epoch", "bucket"])
    rows = rows.withColumn("pos", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inside"))
    return rows.where("pos < quota or (n_tokens = 0 and pos = quota)")


def mix(docs: DataFrame, n_tokens: Column | None = None, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """(block, pos, doc_id, source, epoch, n_tokens, __h): the mixed sequence.

    ``n_tokens`` is the length of a document, by default its words. ``block`` and
    ``pos`` number the blocks and what is in each, ``epoch`` counts the passes
    over the source. ``target_entropy`` has precedence over ``max_repeats``.

    * A NULL source is the same as an empty one. Sources without a token have no
      share and take no part; documents without one are drawn along with others.
    * Rows that repeat doc_id and text are one document; NULL doc_ids, and rows
      that share only the doc_id, are documents of their own.
    * A document is drawn whole: a source exceeds its quota by less than the last.
    * Equal hashes are taken by length and the hash of the text. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    length = word_count(F.col("text")) if n_tokens is None else n_tokens
    keyed = only(docs, "doc_id", "text", "source").select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), length.cast("long").alias("n_tokens"))
    sized = collapse_repeats(keyed)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = sized.select("doc_id", "__h", "source", "n_tokens", key.alias("key"))
    sized = materialise(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    sources = materialise(sources, "mix-sources")
    quotas = source_budgets(sources, exponent(sources, target_entropy, max_repeats, budget), budget)
    total = quotas.agg(F.sum("quota").alias("q")).first()["q"] or 0
    blocks = max(1, -(-total // block_tokens))
    drawn = draw(sized, quotas, seed)
    block = F.least(F.floor(F.col("pos").cast("double") * F.lit(float(blocks)) / F.col("quota")), F.lit(blocks - 1)).cast("long")
    order = W.partitionBy("block").orderBy("order", "source", "key", "n_tokens", "__h")
    out = drawn.withColumn("block", block).withColumn("rank", F.row_number().over(order) - 1)
    return out.select("block", F.col("rank").cast("long").alias("pos"), "doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens", "__h")


def mix_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` draws them, in its order, columns as they are.

    Rows come in ranges of whole runs of (block, pos), sorted, so that the files that
    are written from them hold the mixed sequence. NULLs, sources without a token,
    repeated rows and an empty table are treated as in :func:`mix`; a row whose
    source has no token goes.
    """
    return shielded(docs, ["doc_id", "text", "source"], lambda inner: _sequence(inner, kwargs))


def _sequence(docs: DataFrame, kwargs: dict) -> DataFrame:
    places = mix(docs, **kwargs).select("doc_id", "__h", "block", "pos")
    places = materialise(places.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"), F.struct("block", "pos").alias("__at")), "mix-places")
    drawn = collapse_repeats(docs).join(places, F.expr("doc_id <=> __id and __h <=> __g"))
    return drawn.repartitionByRange("__at").sortWithinPartitions("__at").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that no source is repeated more than four times."""
    return mix(documents(spark, sf_dir)).drop("__h")


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS key,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens
  FROM documents),
src AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
ext AS (SELECT max(tokens)::DOUBLE AS hi, min(tokens)::DOUBLE AS lo FROM src),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN pow(hi / lo, 1 - (low + high) / 2) > {MAX_REPEATS} THEN (low + high) / 2 ELSE low END,
         CASE WHEN pow(hi / lo, 1 - (low + high) / 2) > {MAX_REPEATS} THEN high ELSE (low + high) / 2 END
  FROM bis, ext WHERE i < {STEPS}),
a AS (SELECT CASE WHEN hi = lo THEN 1.0::DOUBLE WHEN hi / lo <= {MAX_REPEATS} THEN 0.0::DOUBLE ELSE ceil(high * 1e{DIGITS}) / 1e{DIGITS} END AS a FROM bis, ext WHERE i = {STEPS}),
q AS (SELECT source, tokens, floor(hi * pow(tokens / hi, a) + 0.5)::BIGINT AS quota FROM src, ext, a),
n AS (SELECT greatest(1, -(-sum(quota)::BIGINT // {BLOCK_TOKENS}))::BIGINT AS blocks FROM q),
e AS (
  SELECT d.*, tokens, quota, unnest(range(0, greatest(ceil(quota / tokens), 1)::BIGINT)) AS epoch
  FROM d JOIN q USING (source)),
o AS (SELECT *, md5('0:' || epoch || ':' || key) AS ord FROM e),
p AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY source, epoch ORDER BY ord, n_tokens, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM o),
b AS (
  SELECT *, least(floor(off::DOUBLE * blocks::DOUBLE / quota), blocks - 1)::BIGINT AS block
  FROM p, n WHERE off < quota OR (n_tokens = 0 AND off = quota))
SELECT block, (row_number() OVER (PARTITION BY block ORDER BY ord, source, key, n_tokens) - 1)::BIGINT AS pos,
       doc_id, source, epoch::BIGINT AS epoch, n_tokens
FROM b
"""
