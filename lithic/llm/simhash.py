"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every document gets ``TABLES`` independent SimHash fingerprints of ``BITS`` bits
over its set of lower-case words. Two fingerprints of one table are within
``RADIUS`` bits exactly if the balls of half that radius around them share a
point, so each fingerprint emits every variant within ``RADIUS / 2`` flips and
fingerprints that meet in a variant are a colliding pair. Colliding pairs are
verified on all tables' bits at once.

The shuffle goes by variant, but not one row for each: variants that share their
leading bits travel as the one fingerprint they come from. A fingerprint is sent
to every leading-bit pattern that some variant of it has, and the receiving
task writes out the variants below that pattern. With 4 leading bits that is 11
rows in place of the 821 variants of a 40-bit fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    batches_of,
    collapse_repeats,
    connected_components,
    documents,
    materialise,
    mix64,
    only,
    shielded,
    sliced,
    words,
)

BITS = 40
TABLES = 5
RADIUS = 4
#: Bits, of all tables together, by which two near copies differ at most. A pair
#: of unrelated texts of one language differs in about 90 of the 200.
MAX_DIFF = 44
#: Fingerprints that one (table, leading bits) group holds, about.
GROUP_ROWS = 1 << 22
#: Variants that a task holds at once.
BUDGET = 1 << 20
WIDTH = BITS * TABLES // 8
CHUNK = 1 << 17


# ------------------------------------------------------------------ fingerprints
def fingerprints(texts: list[str]) -> list[bytes | None]:
    """Fingerprint of each text, all tables' bits in a row; None for a blank one.

    A text without a word gets hash bits of all its characters, so that equal ones meet.
    """
    out: list[bytes | None] = [None] * len(texts)
    for lo, hi in batches_of(map(len, texts), CHUNK):
        hashes, where = words(texts[lo:hi])
        if not len(hashes):
            continue
        # each word counts once a text: 44 bits of its hash tell it from the text's others
        key = np.sort((where.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        key = key[np.diff(key, prepend=~key[:1]) != 0]
        where, hashes = (key >> np.uint64(44)).astype(np.int64), mix64(key << np.uint64(20))
        seeds = (np.arange(-(-WIDTH // 8), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        raw = mix64(hashes[:, None] ^ seeds[None, :]).view(np.uint8)[:, :WIDTH]
        # eight counters of eight bits in each uint64; 255 words fit before one overflows
        lanes = np.unpackbits(raw, axis=1).view(np.uint64).T.copy()
        begin = np.flatnonzero(np.diff(where, prepend=-1))
        size = np.diff(begin, append=len(where))
        parts = -(-size // 255)
        owner = np.repeat(np.arange(len(begin)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sums = np.add.reduceat(lanes, begin[owner] + 255 * nth, axis=1)
        counts = np.ascontiguousarray(sums.T).view(np.uint8).astype(np.int32)
        totals = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)
        packed = np.packbits(2 * totals > size[:, None], axis=1)
        for k, row in zip(where[begin], packed, strict=True):
            out[lo + int(k)] = row.tobytes()
    for k, text in enumerate(texts):
        if out[k] is None and text.strip():
            out[k] = hashlib.shake_128(text.encode("utf-8", "surrogatepass")).digest(WIDTH)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        fps = pa.array(fingerprints(texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__h"), fps], ["doc_id", "__h", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, __h, fp) of every row of ``docs``, which has the column ``__h``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__h", "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, __h long, fp binary")


# ------------------------------------------------------------- ball hashing
def _masks(width: int, most: int) -> np.ndarray:
    """All words of ``width`` bits with ``most`` ones at most."""
    out = [0]
    for n in range(1, most + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(width), n)]
    return np.array(out, np.uint64)


def leading_bits(n: int, bits: int = BITS, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> int:
    """Leading bits to shuffle on: the fewest, 4 at least, that keep groups small."""
    for q in range(min(4, bits - radius), bits - radius):
        if n * len(_masks(q, radius // 2)) <= group_rows << q:
            return q
    return bits - radius


def table_values(fps: np.ndarray, table: int) -> np.ndarray:
    """The ``BITS`` bits of one table as integers; ``fps`` is (n, WIDTH) bytes."""
    at, size = table * BITS // 8, BITS // 8
    out = np.zeros(len(fps), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | fps[:, at + k].astype(np.uint64)
    return out


def _sender(q: int):
    half = RADIUS // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(q, half)
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, WIDTH)
            groups, blobs = [], []
            for t in range(TABLES):
                lead = table_values(fps, t) >> np.uint64(BITS - q)
                to = (lead[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, row = to[order], order // len(masks)
                cut = np.flatnonzero(np.diff(to, prepend=np.uint64(1 << 63)))
                for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
                    groups.append((t << q) | int(to[a]))
                    blobs.append(fps[row[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])

    return send


def _wide(fps: np.ndarray) -> np.ndarray:
    out = np.zeros((len(fps), -(-WIDTH // 8) * 8), np.uint8)
    out[:, :WIDTH] = fps
    return out.view(np.uint64)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _span(members: np.ndarray, wide: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of ``members`` under the verified relation."""
    left, edges = members, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            near = _distance(wide[left], wide[k]) <= MAX_DIFF
            edges += [(int(k), int(j)) for j in left[near]]
            front += list(left[near])
            left = left[~near]
    return edges


def _collide(values: np.ndarray, lead: int, q: int, budget: int) -> Iterator[np.ndarray]:
    """Sets of positions in ``values`` (distinct) that meet in one variant.

    Variants below the leading bits ``lead`` only. Yields for every part of
    the variant space the positions sorted by variant and the run starts.
    """
    half = RADIUS // 2
    far = np.bitwise_count((values >> np.uint64(BITS - q)) ^ np.uint64(lead)).astype(np.int64)
    near = far <= half
    pos, values, far = np.flatnonzero(near), values[near], far[near]
    if len(pos) < 2:
        return
    width = BITS - q
    total = sum(int((far == d).sum()) * len(_masks(width, half - d)) for d in range(half + 1))
    if total > budget and width > RADIUS:
        # halve the variant space rather than hold all of it
        for bit in (0, 1):
            for a, b in _collide(values, (lead << 1) | bit, q + 1, budget):
                yield pos[a], b
        return
    keys, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(far == d)
        masks = _masks(width, half - d)
        low = values[own] & np.uint64((1 << width) - 1)
        keys.append((low[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    if width + len(values).bit_length() <= 64:
        shift = np.uint64(len(values).bit_length())
        both = np.sort((key << shift) | owner.astype(np.uint64))
        key, owner = both >> shift, (both & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    else:
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), bool)
    keep[1:] |= same
    keep[:-1] |= same
    key, owner = key[keep], owner[keep]
    if len(key):
        yield pos[owner], np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)))


def group_edges(fps: np.ndarray, table: int, lead: int, q: int, budget: int = BUDGET) -> np.ndarray:
    """Edges (i, j) between rows of ``fps`` (distinct) found in one group.

    They span the components of the relation "within RADIUS in this table with
    a common variant below ``lead``, and within MAX_DIFF over all bits".
    """
    wide = _wide(fps)
    full = table_values(fps, table)
    values, inverse = np.unique(full, return_inverse=True)
    members = np.argsort(inverse, kind="stable")
    size = np.bincount(inverse, minlength=len(values))
    at = np.cumsum(size) - size
    edges: list[tuple[int, int]] = []
    # equal in this table: they meet in every variant; take the ones at home here
    for k in np.flatnonzero((size > 1) & (values >> np.uint64(BITS - q) == lead)):
        edges += _span(members[at[k] : at[k] + size[k]], wide)
    seen = np.zeros(0, np.uint64)
    for owner, begin in _collide(values, lead, q, budget):
        # every run against its first value's first row; only runs that this
        # leaves apart are looked at pair by pair
        runs = np.diff(begin, append=len(owner))
        n = size[owner]
        rows = members[np.repeat(at[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        length = np.add.reduceat(n, begin)
        pivot = np.repeat(members[at[owner[begin]]], length)
        pair = (pivot.astype(np.uint64) << np.uint64(32)) | rows.astype(np.uint64)
        uniq, back = np.unique(pair, return_inverse=True)
        i, j = (uniq >> np.uint64(32)).astype(np.int64), (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64)
        good = np.concatenate([_distance(wide[i[s : s + 65536]], wide[j[s : s + 65536]]) <= MAX_DIFF for s in range(0, len(i), 65536)])
        fresh = good & (i != j) & ~np.isin(uniq, seen)
        seen = np.union1d(seen, uniq[fresh])
        edges += zip(i[fresh].tolist(), j[fresh].tolist(), strict=True)
        start = np.cumsum(length) - length
        apart = ~np.logical_and.reduceat(good[back], start)
        done = set()
        for r in np.flatnonzero(apart & (length > 2)):
            own = np.unique(rows[start[r] : start[r] + length[r]])
            if (key := own.tobytes()) not in done:
                done.add(key)
                edges += _span(own, wide)
        del runs
    return np.array(sorted(set(edges)), np.int64).reshape(-1, 2)


def _receiver(q: int):
    def receive(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        fps = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint8).reshape(-1, WIDTH)
        e = group_edges(fps, grp >> q, grp & ((1 << q) - 1), q)
        raw = fps.tobytes()
        cut = lambda k: raw[k * WIDTH : (k + 1) * WIDTH]
        return pa.table({"a": pa.array([cut(i) for i in e[:, 0]], pa.binary()), "b": pa.array([cut(j) for j in e[:, 1]], pa.binary())})

    return receive


def near_edges(fps: DataFrame) -> DataFrame:
    """Verified edges (a, b) between the distinct fingerprints ``fps`` (fp).

    They span the components of "within RADIUS in some table and within
    MAX_DIFF over all": pairs already joined through others may be left out.
    """
    q = leading_bits(fps.count())
    sent = fps.mapInArrow(_sender(q), "grp long, blob binary")
    return sent.groupBy("grp").applyInArrow(_receiver(q), "a binary, b binary")


def near_groups(keyed: DataFrame) -> DataFrame:
    """(doc_id, __h, first_id, first_h): what each document duplicates.

    ``keyed`` has doc_id, __h and text, each (doc_id, __h) once. One row for
    every document of a group of two or more; (first_id, first_h) is the
    smallest of the group, which stays. Blank documents are in none.
    """
    marked = materialise(with_fingerprints(keyed).where("fp is not null"), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "__h")).alias("first"), F.count("*").alias("n")), "simhash-nodes")
    parts = connected_components(near_edges(nodes.select("fp")), "simhash-cc")
    # a fingerprint's group: its component's smallest first, or its own
    rooted = parts.join(nodes, parts.node == nodes.fp).groupBy("component").agg(F.min("first").alias("root"))
    joined = parts.join(rooted, "component").select(F.col("node").alias("fp"), "root")
    groups = nodes.join(joined, "fp", "left").where("n > 1 or root is not null")
    groups = groups.select("fp", F.coalesce("root", "first").alias("root"))
    return marked.join(groups, "fp").select("doc_id", "__h", F.col("root.doc_id").alias("first_id"), F.col("root.__h").alias("first_h"))


def simhash_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id) of every document that near-dedup removes.

    kept_id is the smallest doc_id of the group, which is kept. Two documents
    are near copies if one of their 40-bit fingerprints differs in 4 bits at
    most and all 200 bits in 44 at most; groups are the connected components.

    * NULL, empty and blank texts have no fingerprint and are never removed. Texts
      without a word are near copies only of equal ones. ``doc_id`` must be a number.
    * NULL doc_ids sort first, so such a row is the one kept; a removed row with
      a NULL doc_id is listed with it.
    * Rows that repeat doc_id and text are one document. Rows that share only
      the doc_id are documents of their own.
    * Texts of any length are read whole. Ties take the smallest doc_id, then the
      smallest text hash. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    keyed = collapse_repeats(only(docs, "doc_id", "text"))
    pairs = near_groups(keyed).where("not (doc_id <=> first_id and __h <=> first_h)")
    return pairs.select("doc_id", F.col("first_id").alias("kept_id"))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that :func:`simhash_duplicates` removes.

    Columns stay as they are; rows that repeat doc_id and text stay once.
    """
    return shielded(docs, ["doc_id", "text"], _dedup)


def _dedup(docs: DataFrame) -> DataFrame:
    keyed = collapse_repeats(docs)
    gone = near_groups(keyed.select("doc_id", "__h", "text"))
    gone = gone.where("not (doc_id <=> first_id and __h <=> first_h)").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"))
    kept = keyed.join(gone, F.expr("doc_id <=> __id and __h = __g"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies of all documents: (doc_id, kept_id) of every one removed."""
    return simhash_duplicates(documents(spark, sf_dir))
