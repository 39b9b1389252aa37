"""Sharding by extendible hashing.

A document's shard is a prefix of its hash bits. The directory starts with the
empty prefix; only a bucket over the byte limit splits on one more bit, until
every shard fits. Bits are looked at ``STEP`` at a time: one aggregation gives
the bytes under every prefix of that many more bits, from which all splits down
to that depth follow, and only buckets that are still too large go on to the
next step. What is aggregated is a hash and a length, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, only

#: Bytes of text a shard holds at most.
LIMIT = 1 << 26
BITS = 60
STEP = 10


def key_hash(key: Column, text: Column) -> Column:
    """First 60 bits of the MD5 of a key and a text; NULL counts as the empty text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def _prefix_bits(prefix: str, depth: str) -> Column:
    return F.expr(f"case when {depth} = 0 then '' else lpad(bin({prefix}), cast({depth} as int), '0') end")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(at, slot, depth, shard): which shard the hashes below a slot belong to.

    ``rows`` has ``h`` and ``n_bytes``. A slot is the first ``at`` bits of a
    hash; a shard of ``depth`` bits owns 2^(at - depth) of them. A bucket whose
    rows all have one hash can't split and is a shard whatever its size.
    """
    done, open_rows, base = None, rows, 0
    while True:
        at = min(base + STEP, BITS)
        fine = open_rows.groupBy(F.expr(f"shiftrightunsigned(h, {BITS - at})").alias("slot"))
        fine = materialise(fine.agg(F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")), "shards-fine")
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(at))))
        levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {at} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = sums.where((F.col("n_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix")
        found = levels.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
        slots = fine.select("slot").join(found, "slot", "left").withColumn("at", F.lit(at))
        slots = slots.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {at} - depth)"))
        slots = slots.select("at", "slot", "depth", _prefix_bits("prefix", "depth").alias("shard"))
        slots = materialise(slots, "shards")
        sealed = slots.where("depth is not null")
        done = sealed if done is None else done.union(sealed)
        left = slots.where("depth is null").select("slot")
        if left.isEmpty():
            return done
        open_rows = open_rows.join(left, F.expr(f"shiftrightunsigned(h, {BITS - at})") == F.col("slot"), "left_semi")
        base = at


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, n_bytes) of every row of ``docs``.

    ``shard`` is the prefix of hash bits, as text, and ``depth`` its length.

    * The hash is that of doc_id and text, so rows that share a doc_id, NULL or not,
      spread. Rows that repeat both share a shard, which alone may exceed ``limit``
      (as may a single text that is longer than it).
    * A NULL or empty text has 0 bytes. A table that fits, or an empty one, isn't
      split: its shard is the empty prefix.
    * Other columns are ignored, whatever their names.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    rows = only(docs, "doc_id", "text").select("doc_id", key_hash(F.col("doc_id"), F.col("text")).alias("h"), size.alias("n_bytes"))
    rows = materialise(rows, "shards-rows")
    out = _located(rows, directory(rows.select("h", "n_bytes"), limit))
    return out.select("doc_id", "found.shard", F.col("found.depth").cast("int").alias("depth"), "n_bytes")


def _located(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows``, which have ``h``, with ``found``: shard and depth by the directory."""
    steps = sorted(r["at"] for r in slots.select("at").distinct().collect())  # BITS / STEP at most
    out = rows
    for k, at in enumerate(steps):
        part = slots.where(F.col("at") == at).select(F.col("slot").alias(f"slot{k}"), F.struct("shard", "depth").alias(f"found{k}"))
        out = out.join(part, F.expr(f"shiftrightunsigned(h, {BITS - at})") == F.col(f"slot{k}"), "left")
    found = F.coalesce(*[F.col(f"found{k}") for k in range(len(steps))]) if steps else F.struct(F.lit("").alias("shard"), F.lit(0).alias("depth"))
    return out.withColumn("found", found)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as Parquet with one folder a shard, ``shard=<bits>_``.

    Every row is written once, with its columns as they are; NULLs, repeated rows,
    ties and an empty table are treated as in :func:`assign_shards`.
    """
    used = {c.lower() for c in docs.columns}
    name = next(n for n in ("shard", "shard_bits", *(f"shard_{k}" for k in range(len(used) + 1))) if n not in used)
    places = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*places)
    key, text = (F.col(places[docs.columns.index(c)]) for c in ("doc_id", "text"))
    inner = inner.withColumn("h", key_hash(key, text))
    rows = inner.select("h", F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    out = _located(inner, directory(rows, limit)).withColumn("to", F.concat("found.shard", F.lit("_")))
    out = out.select(*[F.col(p).alias(c) for p, c in zip(places, docs.columns, strict=True)], F.col("to").alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return assign_shards(documents(spark, sf_dir))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
p AS (
  SELECT k AS depth, h >> ({BITS} - k) AS prefix, sum(n_bytes) AS b, min(h) = max(h) AS one
  FROM d, (SELECT unnest(range(0, {BITS + 1})) AS k) GROUP BY ALL),
fit AS (SELECT depth, prefix FROM p WHERE b <= {LIMIT} OR one),
found AS (
  SELECT d.h, min(fit.depth) AS depth
  FROM (SELECT DISTINCT h FROM d) d JOIN fit ON d.h >> ({BITS} - fit.depth) = fit.prefix
  GROUP BY d.h)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth::INT, '0') END AS shard,
       depth::INT AS depth, n_bytes
FROM d JOIN found USING (h)
"""
