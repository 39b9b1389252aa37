"""Exact top-k search among binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments. Two codes within distance m (s + 1) - 1 agree in
one of their m segments up to s bits, so searching every segment within radius s
covers that distance. Each round looks at segment values at exactly the next
radius for the queries whose kth distance isn't covered yet.

The index is written once, bucketed by segment and the segment's leading bits. What
moves in a round are the open queries: each is sent to every leading-bit pattern
within the radius and looks up the remaining bits there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialise, only, shared_dir

K = 10
BITS = 64
#: Candidates that a task looks at in one go.
BUDGET = 1 << 22
_ITEM = np.dtype([("code", "<u8"), ("id", "<i8")])
_QUERY = np.dtype([("code", "<u8"), ("id", "<i8"), ("bound", "<i8")])
_FOUND = "qid long, qcode long, distance int, id long, code long"


# ------------------------------------------------------------------------ codes
def sign_codes(vectors: np.ndarray) -> np.ndarray:
    """64-bit codes of the rows: signs of the 64 dimensions, or of 64 projections."""
    if vectors.shape[1] != BITS:
        plane = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], BITS))
        vectors = np.nan_to_num(vectors.astype(float)) @ plane
    return np.packbits(vectors > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("embedding").to_pylist()
        out: list[int | None] = [None] * len(rows)
        by_size: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            if r:
                by_size.setdefault(len(r), []).append(k)
        for own in by_size.values():
            grid = np.array([[np.nan if x is None else x for x in rows[k]] for k in own], float)
            for k, code in zip(own, sign_codes(grid).view(np.int64).tolist(), strict=True):
                out[k] = code
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.int64())], ["vec_id", "code"])


def binary_codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code) of the rows that have an embedding and an id."""
    rows = only(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_code_batches, "vec_id long, code long").where("code is not null and vec_id is not null")


# ----------------------------------------------------------------------- search
def layout(n: int) -> tuple[int, int]:
    """(bits of a segment, leading bits to shuffle on) for ``n`` codes.

    Longer segments for more codes keep the items that share one few; the search is
    exact whatever the length.
    """
    width = 8 if n <= 1 << 10 else 16 if n <= 1 << 26 else 32
    lead = max(min(4, (n >> 8).bit_length()), (n >> 20).bit_length())
    return width, min(lead, width - 4)


def _masks(width: int, ones: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), ones)], np.uint64)


def _segment(codes: np.ndarray, k: int, width: int) -> np.ndarray:
    return (codes >> np.uint64(BITS - width * (k + 1))) & np.uint64((1 << width) - 1)


def _sender(width: int, lead: int, radius: int, query: bool):
    """Rows (grp, blob); a query goes to all leading bits within ``radius``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.concatenate([_masks(lead, d) for d in range(min(radius, lead) + 1)]) if query else np.zeros(1, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, _QUERY if query else _ITEM)
            rows["code"] = batch.column("code").to_numpy().view(np.uint64)
            rows["id"] = batch.column("id").to_numpy()
            if query:
                rows["bound"] = batch.column("bound").to_numpy()
            groups, blobs = [], []
            for k in range(BITS // width):
                own = _segment(rows["code"], k, width) >> np.uint64(width - lead)
                to = (own[:, None] ^ near[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, row = to[order].astype(np.int64), order // len(near)
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
                    groups.append((k << lead) | int(to[a]))
                    blobs.append(rows[row[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])

    return send


@contextmanager
def _index(items: DataFrame, width: int, lead: int) -> Iterator[DataFrame]:
    """The items by group, in a table of the shared folder that is bucketed by group.

    A round's join reads the buckets in place; only the queries are shuffled to them.
    """
    spark = items.sparkSession
    name = f"topk_index_{uuid.uuid4().hex}"
    buckets = max(1, min((BITS // width) << lead, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = items.mapInArrow(_sender(width, lead, 0, False), "grp long, blob binary").repartition(buckets, "grp")
    path = f"{shared_dir(spark)}/{name}"
    sent.write.bucketBy(buckets, "grp").sortBy("grp").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._written = path
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE {name}")
        discard(table)


def search_group(items: np.ndarray, queries: np.ndarray, part: int, width: int, lead: int, radius: int, k: int) -> Iterator[pa.Table]:
    """The k nearest of each query among the items whose segment is ``radius`` away."""
    seg, pattern = part >> lead, part & ((1 << lead) - 1)
    low_bits = width - lead
    low = _segment(items["code"], seg, width) & np.uint64((1 << low_bits) - 1)
    order = np.argsort(low, kind="stable")
    items = items[order]
    values, begin = np.unique(low[order], return_index=True)
    size = np.diff(begin, append=len(items))
    own = _segment(queries["code"], seg, width)
    away = np.bitwise_count((own >> np.uint64(low_bits)) ^ np.uint64(pattern)).astype(np.int64)
    own = own & np.uint64((1 << low_bits) - 1)
    for d in range(min(radius, lead) + 1):
        left = radius - d
        if left > low_bits:
            continue
        some = np.flatnonzero(away == d)
        masks = _masks(low_bits, left)
        scan = len(masks) > len(values)
        step = max(1, BUDGET // max(1, min(len(masks), len(values))))
        for lo in range(0, len(some), step):
            q = some[lo : lo + step]
            if scan:  # fewer values than variants
                hit, at = np.nonzero(np.bitwise_count(own[q][:, None] ^ values[None, :]) == left)
            else:
                want = (own[q][:, None] ^ masks[None, :]).ravel()
                at = np.searchsorted(values, want)
                found = values[np.minimum(at, len(values) - 1)] == want
                hit, at = np.flatnonzero(found) // len(masks), at[found]
            many = np.cumsum(size[at])
            cuts = np.searchsorted(many, np.arange(0, (many[-1] if len(many) else 0) + BUDGET, BUDGET))
            # a query's hits stay together: cuts move to where the next query starts
            cuts = np.unique([0, *(np.searchsorted(hit, hit[min(c, len(hit) - 1)]) for c in cuts if len(hit)), len(hit)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = size[at[a:b]]
                row = np.repeat(begin[at[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                who = q[np.repeat(hit[a:b], n)]
                query, item = queries[who], items[row]
                far = np.bitwise_count(query["code"] ^ item["code"]).astype(np.int64)
                good = np.flatnonzero((far <= query["bound"]) & ((query["id"] != item["id"]) | (far > 0)))
                who, far, item = who[good], far[good], item[good]
                rank = np.lexsort((item["code"], item["id"], far, who))
                who, far, item = who[rank], far[rank], item[rank]
                first = np.searchsorted(who, who)
                top = np.arange(len(who)) - first < k
                query, item = queries[who[top]], item[top]
                yield pa.table({"qid": query["id"], "qcode": query["code"].view(np.int64), "distance": far[top].astype(np.int32), "id": item["id"], "code": item["code"].view(np.int64)})


def _receiver(width: int, lead: int, radius: int, k: int):
    def receive(items: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "qcode": pa.array([], pa.int64()), "distance": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "code": pa.array([], pa.int64())})
        if not items.num_rows or not queries.num_rows:
            return empty
        part = items.column("grp")[0].as_py()
        whole, asked = (np.frombuffer(b"".join(t.column("blob").to_pylist()), kind) for t, kind in ((items, _ITEM), (queries, _QUERY)))
        return pa.concat_tables([empty, *search_group(whole, asked, part, width, lead, radius, k)])

    return receive


def top_k(codes: DataFrame, k: int = K, queries: Column | str | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the ``k`` nearest codes of every query.

    ``codes`` has vec_id and code (64 bits, as a long). ``queries`` is a condition on
    vec_id for the rows whose neighbours are asked for, by default all; the search is
    among all rows. Exact: a query's search ends only when its kth distance is covered.
    Distance is that of Hamming, ``rank`` counts from 1; equal distances are taken by
    neighbour_id, then by code.

    * A row isn't its own neighbour. Rows that repeat vec_id and code are one; rows
      that share only the vec_id are items of their own. ``vec_id`` must be a number.
    * Rows with a NULL vec_id or code take no part.
    * With fewer than ``k`` others each query has all of them; one row alone, or an
      empty table, gives no rows.
    * Other columns are ignored, whatever their names.
    """
    named = only(codes, "vec_id", "code")
    asked = F.lit(True) if queries is None else F.expr(queries) if isinstance(queries, str) else queries
    rows = named.withColumn("asked", F.coalesce(asked, F.lit(False))).where("vec_id is not null and code is not null")
    items = materialise(rows.groupBy(F.col("vec_id").cast("long").alias("id"), "code").agg(F.max("asked").alias("asked")), "topk")
    wanted = items.where("asked").select("id", "code")
    n = items.count()
    width, lead = layout(n)
    segments, need = BITS // width, min(k, n - 1)
    found = best = None
    active = wanted.withColumn("bound", F.lit(BITS).cast("long"))
    if need <= 0 or wanted.isEmpty():
        return codes.sparkSession.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance int")
    with _index(items.select("id", "code"), width, lead) as index:
        for radius in range(width + 1):
            sent = active.mapInArrow(_sender(width, lead, radius, True), "grp long, blob binary")
            new = index.groupBy("grp").cogroup(sent.groupBy("grp")).applyInArrow(_receiver(width, lead, radius, k), _FOUND)
            rows = (new if found is None else found.union(new)).distinct()
            order = W.partitionBy("qid", "qcode").orderBy("distance", "id", "code")
            ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            last, best = best, materialise(ranked, "topk-best")
            found = best.drop("rank")
            covered = segments * (radius + 1) - 1
            kth = best.groupBy("qid", "qcode").agg(F.max("distance").cast("long").alias("kth"), F.count("*").alias("n"))
            state = wanted.join(kth, (F.col("id") == F.col("qid")) & (F.col("code") == F.col("qcode")), "left")
            state = state.where((F.coalesce("n", F.lit(0)) < need) | (F.col("kth") > covered))
            bound = F.when(F.coalesce("n", F.lit(0)) >= need, F.col("kth")).otherwise(F.lit(BITS)).cast("long")
            before, active = active, materialise(state.select("id", "code", bound.alias("bound")), "topk-active")
            discard(before, *([last] if last is not None else []))
            if active.isEmpty():
                break
    return best.select(F.col("qid").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")


#: Whose neighbours the query asks for.
ASKED = "vec_id % 100 = 0"


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every one whose id is divisible by 100."""
    return top_k(binary_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), queries=ASKED)


OP8_SQL = f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS bits FROM e),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id,
         len(list_filter(range(1, {BITS + 1}), lambda i: a.bits[i] <> b.bits[i]))::INT AS distance
  FROM c a, c b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INT AS rank FROM p)
SELECT vec_id, rank, neighbour_id, distance FROM r WHERE rank <= {K}
"""
