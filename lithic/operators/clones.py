"""Clone detection over token windows.

Every window of ``min_tokens`` normalised tokens is hashed where its file's tokens are;
what is shuffled is (hash, file, position), packed. Windows that repeat are extended together
while the next tokens agree; of the overlapping groups this gives, the longest claim
their lines first. Claiming is sequential, but only among files that share a window,
so it runs once for each connected component of files.

Windows don't cross files, and two independent 64-bit hashes must agree.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .findings import finding
from .graph import weak_components

FRAGMENT = "struct<file:string,start_line:int,end_line:int,lines_of_code:int>"
GROUPS = f"token_count int, line_count int, fragments array<{FRAGMENT}>"


#: Input bytes of a bucket of windows, about; one bucket is held at a time.
BUCKET_BYTES = 1 << 21


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _window_hashes(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every run of ``length`` ids."""
    out = []
    for seed, by in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)):
        own, n = _mixed(ids, seed), len(ids) - length + 1
        total = np.zeros(n, np.uint64)
        for k in range(length):
            total = total * np.uint64(by) + own[k : k + n]
        out.append(_mixed(total, seed))
    return out[0], out[1]


def _packed(length: int, buckets: int, all_places: bool):
    """Windows of a batch as a table a bucket in few bytes: sorted, the first hash as steps from one to the next."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("ids").is_valid())
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            counts = np.maximum(sizes - length + 1, 0)
            if not counts.sum():
                continue
            row = np.repeat(np.arange(len(sizes)), counts)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            h, c = _window_hashes(ids, length)
            at = np.repeat(np.cumsum(sizes) - sizes, counts) + pos
            h, c = h[at], c[at]
            order = np.argsort(h, kind="stable")
            h, c, row, pos = h[order], c[order], row[order], pos[order].astype(np.int32)
            n = None
            if not all_places:  # a row for a window and document, at its first place
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (row[1:] != row[:-1])))
                n = np.diff(np.append(first, len(h))).astype(np.int32)
                h, c, row, pos = h[first], c[first], row[first], pos[first]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h)).tolist()
            path = batch.column("path")
            for lo, hi in zip(cuts, cuts[1:]):
                own = h[lo:hi]
                steps = np.append(own[:1], own[1:] - own[:-1]).view(np.uint8).reshape(-1, 8).T
                docs, at = np.unique(row[lo:hi], return_inverse=True)
                parts = [np.ascontiguousarray(steps), c[lo:hi], at.astype(np.int32), pos[lo:hi], *([] if n is None else [n[lo:hi]])]
                blob = pa.compress(b"".join(p.tobytes() for p in parts), codec="zstd", asbytes=True)
                value = {"bucket": [int(bucket[lo])], "n": [hi - lo], "blob": [blob]}
                paths = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), path.take(pa.array(docs)))
                yield pa.RecordBatch.from_arrays([pa.array(value["bucket"], pa.int32()), pa.array(value["n"], pa.int32()), pa.array(value["blob"], pa.binary()), paths], ["bucket", "n", "blob", "paths"])

    return pack


def _unpacked(table: pa.Table, all_places: bool) -> tuple[pa.Array, list[np.ndarray]]:
    """Paths in order, and the columns h, c, path's number, pos, n, sorted by the first four."""
    parts: list[list[np.ndarray]] = []
    every = pa.concat_arrays([x.flatten() for x in table.column("paths").chunks])
    known = every.unique().drop_null()
    known = known.take(pc.sort_indices(known))
    code = pc.fill_null(pc.index_in(every, known), len(known)).to_numpy(zero_copy_only=False)
    known, base = pa.concat_arrays([known, pa.nulls(1, known.type)]), 0
    for n, blob, paths in zip(table.column("n").to_pylist(), table.column("blob"), table.column("paths"), strict=True):
        raw = np.frombuffer(pa.decompress(blob.as_buffer(), n * (24 if all_places else 28), "zstd"), np.uint8)
        steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
        rest = raw[16 * n :].view(np.int32).reshape(-1, n)
        own = code[base : base + len(paths)]
        base += len(paths)
        parts.append([np.cumsum(steps, dtype=np.uint64), raw[8 * n : 16 * n].view(np.uint64), own[rest[0]], rest[1], np.ones(n, np.int32) if all_places else rest[2]])
    h, c, path, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, path, c, h))
    return known, [x[order] for x in (h, c, path, pos, n)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def _counted(table: pa.Table) -> pa.Table:
    known, (h, c, path, pos, n) = _unpacked(table, False)
    each = _starts(h, c, path)
    first = _starts(h, c)
    times = np.add.reduceat(n, first, dtype=np.int64)
    documents = np.add.reduceat((path[each] < len(known) - 1).astype(np.int64), np.searchsorted(each, first))
    first, times, documents = (x[times > 1] for x in (first, times, documents))
    return pa.table({"path": known.take(pa.array(path[first])), "pos": pos[first], "occurrences": times, "documents": documents})


def _apart(pos: np.ndarray, length: int) -> list[int]:
    """Indices of the sorted ``pos`` that are kept if none may overlap the one kept before."""
    at, out = 0, []
    while at < len(pos):
        out.append(at)
        at = int(np.searchsorted(pos, pos[at] + length))
    return out


def _placed(length: int, least: int):
    def place(table: pa.Table) -> pa.Table:
        known, (h, c, path, pos, _) = _unpacked(table, True)
        often = np.diff(np.append(first := _starts(h, c), len(h)))
        on = np.repeat(often >= least, often)  # the rest can't get there
        h, c, path, pos = h[on], c[on], path[on], pos[on]
        if len(h):
            each = _starts(h, c, path)
            ends = np.append(each[1:], len(h))
            keep = np.zeros(len(h), bool)
            keep[each] = True
            for lo, hi in zip(each[ends - each > 1].tolist(), ends[ends - each > 1].tolist(), strict=True):
                keep[np.array(_apart(pos[lo:hi], length)) + lo] = True
            h, c, path, pos = h[keep], c[keep], path[keep], pos[keep]
            often = np.diff(np.append(first := _starts(h, c), len(h)))
            on = np.repeat(often >= least, often)
            first, often = first[often >= least], often[often >= least]
        else:
            on, first, often = np.zeros(0, bool), np.zeros(0, int), np.zeros(0, int)
        places = pa.StructArray.from_arrays([known.take(pa.array(path[on])), pa.array(pos[on], pa.int32())], ["path", "pos"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(often)), pa.int32()), places)
        return pa.table({"hash": h[first].view(np.int64), "check": c[first].view(np.int64), "positions": lists})

    return place


def _by_window(rows: DataFrame, length: int, all_places: bool, grouped, result: str) -> DataFrame:
    """``grouped`` over the windows of ``rows`` (path, values), all of the same hashes at once.

    A window is 16 bytes of hashes and its place. As rows these would be shuffled, sorted
    and spilled at several times that, so a task's windows travel in a compressed blob for
    each bucket of hashes.
    """
    ids = rows.select("path", F.transform("values", lambda v: F.xxhash64(v)).alias("ids"))
    kind = rows.schema["path"].dataType.simpleString()
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = min(max(size // BUCKET_BYTES, 2 * rows.sparkSession.sparkContext.defaultParallelism), 1 << 13)
    packed = ids.mapInArrow(_packed(length, buckets, all_places), f"bucket int, n int, blob binary, paths array<{kind}>")
    return packed.groupBy("bucket").applyInArrow(grouped, result.format(path=kind))


def window_counts(rows: DataFrame, length: int) -> DataFrame:
    """(path, pos, occurrences, documents) of each window of ``rows`` that repeats; the place is its first."""
    return _by_window(rows, length, False, _counted, "path {path}, pos int, occurrences long, documents long")


def repeated_windows(rows: DataFrame, length: int, min_occurrences: int = 2) -> DataFrame:
    """(hash, check, positions): windows of ``rows`` (path, values) that occur often enough without overlap.

    ``positions`` is sorted by file and place; of overlapping ones in a file the
    first is kept.
    """
    return _by_window(rows, length, True, _placed(length, min_occurrences), "hash long, check long, positions array<struct<path:{path},pos:int>>")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, more): tokens by which two windows agree beyond their length."""
    for batch in batches:
        (xs, x), (ys, y), (ps, pairs) = ((c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten()) for c in (batch.column(n) for n in ("x", "y", "pairs")))
        x, y, grp, p, q = (v.to_numpy(zero_copy_only=False) for v in (x, y, *(pairs.field(n) for n in ("grp", "p", "q"))))
        more = np.zeros(len(p), np.int32)
        for k in range(len(batch)):
            a, b, own = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]], slice(ps[k], ps[k + 1])
            first, shifts = p[own], q[own] - p[own]
            for shift in set(shifts.tolist()):
                lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                stops = np.append(np.flatnonzero(a[lo:hi] != b[lo + shift : hi + shift]) + lo, hi)
                on = shifts == shift
                more[own][on] = stops[np.searchsorted(stops, first[on])] - first[on]
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(more)], ["grp", "more"])


def _claimer(min_lines: int, min_occurrences: int):
    def claim(table: pa.Table) -> pa.Table:
        places = pa.concat_arrays(table.column("places").chunks)
        flat = places.flatten()
        path, pos, start, end = (flat.flatten()[flat.type.get_field_index(n)] for n in ("path", "pos", "start", "end"))
        path = path.dictionary_encode()
        names = path.dictionary.to_pylist()
        code, pos, start, end = (x.to_numpy(zero_copy_only=False) for x in (path.indices, pos, start, end))
        stops = np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False))
        begins = np.append(0, stops[:-1])
        length = table.column("length").to_pylist()
        # no two groups have the same first place
        rows = sorted(range(len(length)), key=lambda k: (-length[k], names[code[begins[k]]], pos[begins[k]]))
        taken: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the claimed lines of each file, which don't overlap
        out: list[tuple[int, list[int]]] = []
        for k in rows:
            own: list[int] = []
            last, last_end = -1, 0
            at = np.arange(begins[k], stops[k])
            at = at[end[at] - start[at] + 1 >= min_lines]
            for i, f, s, e in zip(at.tolist(), code[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True):
                if f == last and s <= last_end:  # places are sorted, so only the one before can overlap
                    continue
                if f in taken:
                    starts, ends = taken[f]
                    if (before := bisect_right(starts, e)) and ends[before - 1] >= s:
                        continue
                own.append(i)
                last, last_end = f, e
            if len(own) >= min_occurrences:
                for f, s, e in zip(code[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True):
                    starts, ends = taken.setdefault(f, ([], []))
                    before = bisect_right(starts, s)
                    starts.insert(before, s)
                    ends.insert(before, e)
                out.append((k, own))
        at = np.array([i for _, own in out for i in own], np.int64)
        lines = (end - start + 1)[at].astype(np.int32)
        ends_at = np.cumsum([0, *(len(own) for _, own in out)]).astype(np.int32)
        kinds = [("file", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("lines_of_code", pa.int32())]
        columns = [pa.array(path.dictionary).take(pa.array(code[at])), pa.array(start[at], pa.int32()), pa.array(end[at], pa.int32()), pa.array(lines, pa.int32())]
        fragments = pa.ListArray.from_arrays(pa.array(ends_at), pa.StructArray.from_arrays(columns, fields=[pa.field(*x) for x in kinds]))
        most = np.maximum.reduceat(lines, ends_at[:-1]) if out else lines
        return pa.table({"token_count": pa.array([length[k] for k, _ in out], pa.int32()), "line_count": pa.array(most, pa.int32()), "fragments": fragments})

    return claim


def clone_groups(rows: DataFrame, min_tokens: int = 50, min_lines: int = 5, min_occurrences: int = 2) -> DataFrame:
    """Rows of ``GROUPS`` for ``rows`` (path, values, lines), one for each clone."""
    rows = materialise(rows.select("path", "values", "lines"), "clone-tokens")  # read four times below
    found = repeated_windows(rows, min_tokens, min_occurrences)
    found = materialise(found.select(F.xxhash64("hash", "check").alias("grp"), "positions"), "clones")
    first = F.col("positions")[0]
    pairs = found.select("grp", first.alias("f"), F.explode(F.slice("positions", F.lit(2), F.size("positions"))).alias("o"))
    pairs = pairs.groupBy(F.col("f.path").alias("a"), F.col("o.path").alias("b"))
    pairs = pairs.agg(F.collect_list(F.struct("grp", F.col("f.pos").alias("p"), F.col("o.pos").alias("q"))).alias("pairs"))
    ids = rows.select("path", F.transform("values", lambda v: F.xxhash64(v)).alias("ids"))
    x, y = ids.select(F.col("path").alias("a"), F.col("ids").alias("x")), ids.select(F.col("path").alias("b"), F.col("ids").alias("y"))
    reach = pairs.join(x, "a").join(y, "b").select("x", "y", "pairs").mapInArrow(_extended, "grp long, more int")
    length = reach.groupBy("grp").agg(F.min("more").alias("length"))
    place = found.join(length, "grp").select("grp", "length", F.posexplode("positions").alias("nth", "p")).select("grp", "length", "p.path", "p.pos")
    lines = rows.select("path", "lines")
    place = place.join(lines, "path").select(
        "grp", "length", "path", "pos", F.col("lines")[F.col("pos")].alias("start"), F.col("lines")[F.col("pos") + F.col("length") - 1].alias("end")
    )
    groups = place.groupBy("grp", "length").agg(F.sort_array(F.collect_list(F.struct("path", "pos", "start", "end"))).alias("places"))
    groups = materialise(groups, "clone-groups")
    links = groups.select(F.explode("places.path").alias("dst"), F.col("places")[0]["path"].alias("src"))
    parts = weak_components(links)
    own = groups.withColumn("node", F.col("places")[0]["path"]).join(parts, "node", "left")
    own = own.select("length", "places", F.coalesce("component", "node").alias("component"))
    return own.groupBy("component").applyInArrow(_claimer(min_lines, min_occurrences), GROUPS)


def clone_findings(groups: DataFrame, severity: str) -> DataFrame:
    """A finding for each group, at its first fragment."""
    first = F.col("fragments")[0]
    count = F.size("fragments")
    places = F.array_join(F.transform("fragments", lambda f: F.concat(f["file"], F.lit(":"), f["start_line"].cast("string"), F.lit("-"), f["end_line"].cast("string"))), ", ")
    message = F.format_string("Duplicate code block (%d tokens, %d lines) appears %d times", "token_count", "line_count", count)
    return finding(
        groups, "duplicate-code", severity, message, first["file"], first["start_line"], end_line=first["end_line"],
        suggestion=F.lit("Extract duplicate code into a shared function or module"),
        metadata=F.create_map(F.lit("fragments"), places, F.lit("token_count"), F.col("token_count").cast("string"), F.lit("occurrences"), count.cast("string")),
    )


def sorted_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("token_count"), F.col("fragments")[0]["file"], F.col("fragments")[0]["start_line"])
