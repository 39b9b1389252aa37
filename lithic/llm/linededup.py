"""Near-duplicate lines: MinHash over character shingles, one line kept a group.

1. A line's shingles are its lower-case substrings of ``SHINGLE`` characters. One
   hash of each fills ``bands * rows`` bins, and ``MARKS`` more, with the least hash
   that falls into them; an empty bin takes over the next filled one (one-permutation
   MinHash). A shingle of a short line gives several hashes, lest one fill a band.
2. Lines that agree in all ``rows`` bins of a band are candidates. What moves is a
   band's hash, the line's 64-bit id and its sketch: four bits of each of the further
   bins. Of candidates whose sketches agree in fewer than ``AGREE`` places nothing
   else is looked at; a pair as similar as ``GOAL`` has one chance in 200 of that.
3. The texts of the remaining candidates alone are joined to the pairs, and pairs
   whose exact Jaccard similarity is ``SIMILARITY`` at least are edges.
4. Distributed union-find over the edges; the first line of a component stays.

In a bucket of up to ``ALL_PAIRS`` lines all pairs are candidates. In a larger one
every line is first verified against the bucket's least; a line that fails, by its
sketch or its text, is then tried against all others of the bucket, so no candidate
pair that could join two components is left out.

Unrelated lines share shingles of frequent words, so the lines that meet by chance
in a band grow with the corpus. ``banding`` adds a row to the bands, and bands to keep
the chance of finding a pair, each time the corpus has grown by as much as the row saves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, codepoints, collapse_repeats, connected_components, discard, documents, materialise, mix64, only, shielded, with_text_hash

SHINGLE = 7
#: A changed word of a line spoils its own shingles and six more, a quarter of 50.
SIMILARITY = 0.5
#: Pairs of this similarity meet in a band with a chance of 1 - ``MISS``.
GOAL = 0.6
MISS = 0.022
ROWS = 4
#: Lines up to which ``ROWS`` are enough, and the growth that asks for another one.
FEW = 1 << 25
STEP = 32
MARKS = 8
AGREE = 2
ALL_PAIRS = 6
#: Entries (band hash, sketch, line) that one group of the shuffle holds, about.
GROUP_ROWS = 1 << 20
CHUNK = 1 << 17
#: Pairs of sketches that a task compares at once.
BUDGET = 1 << 21
#: Hashes for each bin that a short line has at least, and how many one shingle gives at most.
FILL = 1
COPIES = 8
_NONE = np.uint32(0xFFFFFFFF)
_ENTRY = np.dtype([("hash", "<u4"), ("sketch", "<u4"), ("line", "<u8")])
_BLANKS = r"' \t\r\u000b\u000c'"


def banding(lines: int) -> tuple[int, int]:
    """(rows, bands) for a corpus of so many different lines."""
    rows, most = ROWS, FEW
    while lines > most:
        rows, most = rows + 1, most * STEP
    return rows, math.ceil(math.log(MISS) / math.log(1 - GOAL**rows))


# ------------------------------------------------------------------- shingles
def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash (uint32) of every shingle, and the index of its line.

    A line of fewer than ``SHINGLE`` characters is one shingle.
    """
    arr, starts = codepoints(lines)
    n = len(arr)
    size = np.diff(starts, append=n) - 1
    h = np.zeros(n, np.uint32)
    x = (arr + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    for k in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h[: n - k] += x[k:]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(h, np.uint32(shift), out=x)
        h ^= x
        h *= np.uint32(factor)
    np.right_shift(h, np.uint32(16), out=x)
    h ^= x
    count = np.maximum(size - SHINGLE + 1, 1)
    owner = np.repeat(np.arange(len(lines)), count)
    at = np.repeat(starts - (np.cumsum(count) - count), count)
    at += np.arange(len(owner))
    out = h[at]
    for k in np.flatnonzero(size < SHINGLE):
        out[np.searchsorted(owner, k)] = hash_short(lines[k])
    return out, owner


def hash_short(line: str) -> int:
    h = 0x811C9DC5
    for c in line:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    h ^= h >> 16
    h = h * 0x7FEB352D & 0xFFFFFFFF
    return h ^ h >> 15


def _least_hashes(h: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins): the least hash in each bin of each line, ``_NONE`` where it is empty."""
    out = np.full(n * bins, _NONE)
    times = np.clip(-(-FILL * bins // np.bincount(owner, minlength=n)), 1, COPIES)
    for k in range(COPIES):
        if k:
            some = times[owner] > k
            if not some.any():
                break
            owner, h, times = owner[some], h[some], times
        own = h ^ np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)
        part = own >> np.uint32(16)
        own ^= part
        own *= np.uint32(0x45D9F3B)
        np.right_shift(own, np.uint32(15), out=part)
        own ^= part
        np.minimum(own, _NONE - np.uint32(1), out=own)
        cell = own.astype(np.int64)
        cell *= bins
        cell >>= 32
        cell += owner * bins
        np.minimum.at(out, cell, own)
    return out.reshape(n, bins)


def signatures(lines: list[str], rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, bands) uint64, equal in a band if all its bins agree, and the sketches (uint32)."""
    out, sketch = np.zeros((len(lines), bands), np.uint64), np.zeros(len(lines), np.uint32)
    bins = bands * rows + MARKS
    for lo, hi in batches_of((len(x) + 1 for x in lines), CHUNK):
        h, owner = shingles(lines[lo:hi])
        value = _least_hashes(h, owner, hi - lo, bins)
        # the next filled bin, going round, and how far it is
        filled = (value != _NONE).ravel()
        full, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        line, upto = empty // bins, np.cumsum(filled, dtype=np.int32)
        nxt = full[np.minimum(upto[empty], len(full) - 1)]
        first = np.argmax(filled.reshape(-1, bins), axis=1) + np.arange(hi - lo) * bins
        nxt = np.where((nxt > empty) & (nxt // bins == line), nxt, first[line])
        away = (nxt - empty) % bins
        sig = value.astype(np.uint64)
        sig.ravel()[empty] = value.ravel()[nxt] + (away.astype(np.uint64) << np.uint64(33))
        acc = np.zeros((hi - lo, bands), np.uint64)
        for r in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows] + np.uint64(r + 1))
        out[lo:hi] = acc
        marks = (mix64(sig[:, bands * rows :]) & np.uint64(15)).astype(np.uint32)
        sketch[lo:hi] = (marks << (4 * np.arange(MARKS, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
    return out, sketch


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of four bits in which sketches agree."""
    x = a ^ b
    x |= x >> np.uint32(1)
    x |= x >> np.uint32(2)
    return MARKS - np.bitwise_count(x & np.uint32(0x11111111)).astype(np.int64)


def jaccard(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of the shingle sets of a[k] and b[k]."""
    out = np.zeros(len(a))
    for lo, hi in batches_of((len(x) + len(y) + 2 for x, y in zip(a, b, strict=True)), CHUNK):
        both = [s for pair in zip(a[lo:hi], b[lo:hi], strict=True) for s in pair]
        h, owner = shingles(both)
        # pair, hash and side in one key; sorted, a shared shingle is two neighbours that differ in the side alone
        count = np.bincount(owner, minlength=len(both))
        side = np.arange(len(both), dtype=np.uint64)
        key = h.astype(np.uint64)
        key <<= np.uint64(1)
        key |= np.repeat((side >> np.uint64(1) << np.uint64(33)) | (side & np.uint64(1)), count)
        key.sort()
        step = key[1:] ^ key[:-1]
        at = np.flatnonzero(step <= 1)
        pair, again = (key[at] >> np.uint64(33)).astype(np.int64), step[at] == 0
        shared = np.bincount(pair[~again], minlength=hi - lo)
        out[lo:hi] = shared / (count[::2] + count[1::2] - np.bincount(pair, minlength=hi - lo))
    return out


# ----------------------------------------------------------------- line tables
def line_table(keyed: DataFrame) -> DataFrame:
    """(doc_id, __h, line_no, line, check, words, rid): every line that isn't blank.

    ``words`` is the line in lower case, ``line`` and ``check`` are hashes of it with 64
    and 32 bits, ``rid`` numbers the rows once the table is written.
    """
    rows = keyed.select("doc_id", "__h", F.posexplode(F.expr(r"split(text, '\n', -1)")).alias("line_no", "raw")).where(f"ltrim({_BLANKS}, raw) <> ''")
    rows = rows.select("doc_id", "__h", "line_no", F.lower("raw").alias("words"))
    return rows.select("*", F.xxhash64("words").alias("line"), F.hash("words").alias("check"), F.monotonically_increasing_id().alias("rid"))


def numbered_lines(keyed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The line table; (line, n, rid) of the different lines, ``rid`` one of its rows; how many they are.

    Lines that share ``line`` but not ``check`` aren't equal; their ids are made
    anew, with another seed, until no two such lines are left.
    """
    lines = materialise(line_table(keyed), "lines")
    seed = 0
    while True:
        each = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("rid").alias("rid"), (F.min("check") != F.max("check")).alias("unlike"))
        each = materialise(each, "lines-each")
        row = each.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("unlike").cast("long")), F.lit(0)).alias("unlike")).first()
        if not row["unlike"]:
            return lines, each, row["n"]
        seed += 1
        twice = each.where("unlike").select("line", F.lit(True).alias("again"))
        lines = lines.join(twice, "line", "left").withColumn("line", F.when(F.col("again"), F.xxhash64(F.lit(seed), "check", "words")).otherwise(F.col("line"))).drop("again")
        lines = materialise(lines, "lines")


def _sender(bits: int, rows: int, bands: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = np.unique(batch.column("line").to_numpy(), return_index=True)
            if not len(ids):
                continue
            hashes, sketch = signatures(batch.column("words").take(pa.array(first)).to_pylist(), rows, bands)
            entry = np.zeros(len(ids), _ENTRY)
            groups, blobs = [], []
            for band in range(bands):
                h = hashes[:, band]
                lead = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                order = np.argsort(lead, kind="stable")
                entry["hash"], entry["sketch"], entry["line"] = (h & np.uint64(0xFFFFFFFF))[order], sketch[order], ids[order].view(np.uint64)
                lead = lead[order]
                cut = np.flatnonzero(np.diff(lead, prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(lead)], strict=True):
                    groups.append((band << bits) | int(lead[a]))
                    blobs.append(entry[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])

    return send


_PAIRS = {"a": np.int64, "b": np.int64, "bucket": np.int64, "sketch": np.int64, "near": bool}


def bucket_pairs(entries: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of ``_PAIRS`` for one group's entries; a < b.

    ``bucket`` is -1 for a candidate pair. Else it is the number of a bucket that isn't
    listed pair by pair, a is its least line and b one of the others, with its sketch;
    ``near`` says whether the two sketches agree.
    """
    key = np.sort((entries["hash"].astype(np.uint64) << np.uint64(32)) | np.arange(len(entries), dtype=np.uint64))
    h = (key >> np.uint64(32)).astype(np.int64)
    same = h[1:] == h[:-1]
    keep = np.zeros(len(h), bool)
    keep[1:] |= same
    keep[:-1] |= same
    entries = entries[(key[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    entries = entries[np.lexsort((entries["line"].view(np.int64), entries["hash"]))]
    h, line, sketch = entries["hash"].astype(np.int64), entries["line"].view(np.int64), entries["sketch"]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line, sketch = h[fresh], line[fresh], sketch[fresh]
    begin = np.flatnonzero(np.diff(h, prepend=-1))
    size = np.diff(begin, append=len(h))
    out: dict[str, list] = {k: [np.zeros(0, t)] for k, t in _PAIRS.items()}

    def add(i: np.ndarray, j: np.ndarray, bucket: np.ndarray | int, near: np.ndarray) -> None:
        for k, v in (("a", line[i]), ("b", line[j]), ("bucket", np.full(len(i), bucket)), ("sketch", sketch[j].astype(np.int64)), ("near", near)):
            out[k].append(v)

    def near_only(i: np.ndarray, j: np.ndarray) -> None:
        near = agreeing(sketch[i], sketch[j]) >= AGREE
        add(i[near], j[near], -1, np.ones(int(near.sum()), bool))

    for n in range(2, ALL_PAIRS + 1):
        rows = begin[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                near_only(rows + i, rows + j)
    for first, n in zip(begin[size > ALL_PAIRS], size[size > ALL_PAIRS], strict=True):
        rest = np.arange(first + 1, first + n)
        near = agreeing(sketch[rest], sketch[first]) >= AGREE
        add(np.full(n - 1, first), rest, int(h[first]), near)
        apart = rest[~near]
        step = max(1, BUDGET // n)
        for lo in range(0, len(apart), step):
            some = apart[lo : lo + step]
            i, j = np.repeat(some, n - 1), np.tile(rest, len(some))
            # of two lines that are both apart the pair comes up twice
            once = (i < j) | ((i > j) & near[j - first - 1])
            near_only(np.minimum(i, j)[once], np.maximum(i, j)[once])
    return {k: np.concatenate(v) for k, v in out.items()}


def _receive(table: pa.Table) -> pa.Table:
    grp = table.column("grp")[0].as_py()
    pairs = bucket_pairs(np.frombuffer(b"".join(table.column("blob").to_pylist()), _ENTRY))
    # a pair of a small bucket once
    small = pairs["bucket"] < 0
    both = np.stack([pairs["a"][small], pairs["b"][small]])
    both = np.unique(both, axis=1) if both.shape[1] else both
    n, large = both.shape[1], {k: v[~small] for k, v in pairs.items()}
    none = pa.nulls(n, pa.int64())
    return pa.table({
        "a": np.concatenate([both[0], large["a"]]), "b": np.concatenate([both[1], large["b"]]), "grp": pa.array(np.full(n + len(large["a"]), grp)),
        "bucket": pa.concat_arrays([none, pa.array(large["bucket"], pa.int64())]), "sketch": pa.concat_arrays([none, pa.array(large["sketch"], pa.int64())]),
        "near": np.concatenate([np.ones(n, bool), large["near"]]),
    })


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = jaccard(batch.column("x").to_pylist(), batch.column("y").to_pylist()) >= SIMILARITY
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same)], ["a", "b", "same"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, same) of the distinct ``pairs`` (a, b)."""
    x = texts.select(F.col("line").alias("a"), F.col("words").alias("x"))
    y = texts.select(F.col("line").alias("b"), F.col("words").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return materialise(both.mapInArrow(_verify, "a long, b long, same boolean"), "lines-verified")


def _texts_of(wanted: DataFrame, lines: DataFrame, each: DataFrame) -> DataFrame:
    """(line, words) of the lines ``wanted``, each read from one of its rows."""
    rows = each.join(wanted, "line").select("line", "rid")
    return materialise(lines.select("rid", "words").join(rows.hint("shuffle_hash"), "rid").select("line", "words"), "lines-texts")


_AGREE_SQL = "bit_count((x | shiftright(x, 1) | shiftright(x, 2) | shiftright(x, 3)) & 286331153L)"


def similar_lines(lines: DataFrame, each: DataFrame, total: int) -> DataFrame:
    """(node, component) of the lines that have a near copy; see :func:`numbered_lines`."""
    rows, bands = banding(total)
    bits = (total // GROUP_ROWS).bit_length()
    sent = lines.select("line", "words").mapInArrow(_sender(bits, rows, bands), "grp long, blob binary")
    found = materialise(sent.groupBy("grp").applyInArrow(_receive, "a long, b long, grp long, bucket long, sketch long, near boolean"), "lines-pairs")
    pairs = materialise(found.where("near").select("a", "b").distinct(), "lines-distinct")
    stars = found.where("bucket is not null")
    # the other lines of larger buckets too: who fails is tried against them, and the lines are read once
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(stars.select("b")).distinct()
    texts = _texts_of(wanted, lines, each)
    checked = _verified(pairs, texts)
    edges = checked.where("same").select("a", "b")
    # larger buckets: who failed against the least line by its text is tried against all others
    failed = stars.where("near").join(checked.where("not same"), ["a", "b"]).select("grp", "bucket", F.col("b").alias("p"), F.col("sketch").alias("s"))
    failed = materialise(failed, "lines-failed")
    if not failed.isEmpty():
        more = failed.join(stars.select("grp", "bucket", "b", "sketch"), ["grp", "bucket"]).where("p <> b").withColumn("x", F.expr("s ^ sketch"))
        more = more.where(f"{MARKS} - {_AGREE_SQL} >= {AGREE}").select(F.least("p", "b").alias("a"), F.greatest("p", "b").alias("b")).distinct()
        edges = edges.union(_verified(more.join(pairs, ["a", "b"], "left_anti"), texts).where("same").select("a", "b"))
    discard(found, pairs, texts, failed)
    return connected_components(edges, "lines-cc")


def _each_once(docs: DataFrame) -> DataFrame:
    """:func:`collapse_repeats`, which reads the texts only if there is a doc_id that repeats."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return with_text_hash(docs)
    return collapse_repeats(docs)


def line_groups(keyed: DataFrame) -> DataFrame:
    """(doc_id, __h, line_no, first): every line that isn't the first of its group.

    ``first`` is (doc_id, __h, line_no) of the first. ``keyed`` has doc_id, __h and
    text, each (doc_id, __h) once.
    """
    at = F.struct("doc_id", "__h", "line_no")
    lines, each, total = numbered_lines(keyed)
    parts = similar_lines(lines, each, total).select(F.col("node").alias("line"), "component")
    repeated = each.where("n > 1").select("line")
    member = parts.union(repeated.join(parts, "line", "left_anti").select("line", F.col("line").alias("component")))
    rows = materialise(lines.select("doc_id", "__h", "line_no", "line").join(member, "line").select("doc_id", "__h", "line_no", "component"), "lines-groups")
    discard(lines, each)
    groups = rows.groupBy("component").agg(F.min(at).alias("first"))
    return rows.join(groups, "component").where(F.col("first") != at).select("doc_id", "__h", "line_no", "first")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of every line that is removed.

    Lines end at ``\\n`` and are numbered from 0. A line that is equal in lower
    case or whose shingles have a Jaccard similarity of ``SIMILARITY`` at least,
    directly or through others, is in one group with it; the first line by doc_id
    and number stays, wherever the others are.

    * Blank lines are in no group and always stay. NULL and empty texts have none.
    * NULL doc_ids sort first, as one document for each text.
    * Rows that repeat doc_id and text are one document. Rows that share only the
      doc_id are documents of their own, by the hash of their text.
    * Lines of any length are taken whole. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    keyed = _each_once(only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string")))
    rows = line_groups(keyed)
    return rows.select("doc_id", "line_no", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line_no").alias("kept_line_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that :func:`duplicate_lines` lists.

    ``text`` loses them and ``n_chars``, where there is one, is counted again; a
    document with no line left that isn't blank goes. Documents that lose nothing,
    blank ones among them, and other columns stay as they are. Rows that repeat
    doc_id and text stay once.
    """
    return shielded(docs, ["doc_id", "text", "n_chars"], _dedup)


def _dedup(docs: DataFrame) -> DataFrame:
    keyed = _each_once(docs)
    gone = line_groups(keyed.select("doc_id", "__h", "text")).groupBy("doc_id", "__h").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"), "__gone")
    rows = keyed.join(gone, F.expr("doc_id <=> __id and __h <=> __g"), "left")
    rows = rows.withColumn("__parts", F.expr(r"if(__gone is null, null, split(text, '\n', -1))"))
    left = F.expr(r"array_join(transform(array_except(sequence(0, size(__parts) - 1), __gone), i -> __parts[i]), '\n')")
    rows = rows.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    rows = rows.where(r"__gone is null or rlike(__left, '\\S')")
    new = {"text": F.col("__left"), "n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__left")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate lines of all documents that go."""
    return duplicate_lines(documents(spark, sf_dir))
