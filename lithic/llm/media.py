"""Matroska files as packet tables.

The parser reads EBML elements of variable length: clusters with their simple
blocks and block groups, all four ways of lacing, tracks, and cues. Each frame
becomes a row with its track, time stamp and byte range in the file, so payloads
needn't be carried along. The writer makes such files from texts, one frame a
line, and stands in for a table of media, which the test data lack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, documents, only

EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0x1549A966
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
SCALE, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x2AD7B1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or segment of unknown size.
_TOP = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
_MASK = [0] + [(1 << 7 * n) - 1 for n in range(1, 9)]
_INT, _LONG = (1 << 31) - 1, (1 << 63) - 1
#: Lines a cluster holds and time between them in the files that are written.
CLUSTER_LINES = 64
FRAME_MS = 40
CHUNK = 1 << 22


# --------------------------------------------------------------------- parsing
class Truncated(Exception):
    """An element ends outside its parent or the file, or holds a number out of range."""


def element_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(id with its length marker, next position)."""
    if at >= end or not data[at]:
        raise Truncated
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise Truncated
    return int.from_bytes(data[at : at + n], "big"), at + n


def vint(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(value, next position); None for the reserved value of all ones."""
    if at >= end or not data[at]:
        raise Truncated
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Truncated
    value = int.from_bytes(data[at : at + n], "big") & _MASK[n]
    return (None if value == _MASK[n] else value), at + n


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int, bool]:
    """(id, start of the content, its end, whether the size was unknown)."""
    key, at = element_id(data, at, end)
    size, at = vint(data, at, end)
    if size is None:
        return key, at, end, True
    return key, at, at + size, False


def _uint(data: bytes, a: int, b: int, most: int = _LONG) -> int:
    if b - a > 8 or (value := int.from_bytes(data[a:b], "big")) > most:
        raise Truncated
    return value


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame; ``kind``: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise Truncated
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise Truncated
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
    elif kind == 3:
        for k in range(count - 1):
            start = at
            value, at = vint(data, at, end)
            n = at - start
            if k:  # a signed difference to the one before
                value = sizes[-1] + (_MASK[n] if value is None else value) - (_MASK[n] >> 1)
            elif value is None:
                raise Truncated
            sizes.append(value)
    else:
        if (end - at) % count:
            raise Truncated
        sizes = [(end - at) // count] * (count - 1)
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise Truncated
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def _block(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, frames)."""
    track, a = vint(data, a, b)
    if track is None or a + 3 > b:
        raise Truncated
    flags = data[a + 2]
    return track, int.from_bytes(data[a : a + 2], "big", signed=True), flags, lace(data, a + 3, b, flags >> 1 & 3)


def parse(data: bytes) -> tuple[list[tuple], bool]:
    """(packets, whether the file is complete and well-formed).

    A packet: track, track_type, codec, timestamp_ns, duration_ns, keyframe,
    cluster, block, frame, offset, size, cued. What comes before the first fault is
    kept. Frames of one block follow each other by their duration: the block's, divided
    among them, or else the track's default, if it has one. ``cued``: a cue leads to this cluster, track and time.
    """
    scale, tracks, cues, rows, complete = 1_000_000, {}, set(), [], True
    end = len(data)
    top: list[int] = []  # where the segment's content starts

    def track_entry(a: int, b: int) -> None:
        number, kind, codec, default = None, None, None, None
        while a < b:
            key, x, y, _ = _element(data, a, b)
            if y > b:
                raise Truncated
            if key == TRACK_NUMBER:
                number = _uint(data, x, y)
            elif key == TRACK_TYPE:
                kind = _uint(data, x, y, _INT)
            elif key == CODEC:
                codec = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif key == DEFAULT_DURATION:
                default = _uint(data, x, y)
            a = y
        tracks[number] = (kind, codec, default)

    def cue_point(a: int, b: int) -> None:
        time, found = 0, []
        while a < b:
            key, x, y, _ = _element(data, a, b)
            if y > b:
                raise Truncated
            if key == CUE_TIME:
                time = _uint(data, x, y)
            elif key == CUE_POSITIONS:
                track = place = None
                while x < y:
                    inner, p, q, _ = _element(data, x, y)
                    if q > y:
                        raise Truncated
                    if inner == CUE_TRACK:
                        track = _uint(data, p, q)
                    elif inner == CUE_CLUSTER:
                        place = _uint(data, p, q)
                    x = q
                found.append((track, place))
            a = y
        cues.update((track, place, time) for track, place in found)

    def cluster(start: int, a: int, b: int, unknown: bool) -> int:
        time, nth = 0, 0
        position = start - (top[0] if top else 0)
        while a < b:
            key, x, y, _ = _element(data, a, b)
            if unknown and key in _TOP:
                return a
            if y > b:
                raise Truncated
            if key == TIMESTAMP:
                time = _uint(data, x, y)
            elif key == SIMPLE_BLOCK:
                track, rel, flags, frames = _block(data, x, y)
                for k, (offset, size) in enumerate(frames):
                    rows.append((track, time + rel, None, bool(flags & 128), position, nth, k, offset, size, len(frames)))
                nth += 1
            elif key == BLOCK_GROUP:
                block = duration = None
                keyframe = True
                while x < y:
                    inner, p, q, _ = _element(data, x, y)
                    if q > y:
                        raise Truncated
                    if inner == BLOCK:
                        block = (p, q)
                    elif inner == DURATION:
                        duration = _uint(data, p, q)
                    elif inner == REFERENCE:
                        keyframe = False
                    x = q
                if block:
                    track, rel, _, frames = _block(data, *block)
                    for k, (offset, size) in enumerate(frames):
                        rows.append((track, time + rel, duration, keyframe, position, nth, k, offset, size, len(frames)))
                    nth += 1
            a = y
        return a

    def segment(a: int, b: int) -> int:
        nonlocal scale
        while a < b:
            start = a
            key, x, y, unknown = _element(data, a, b)
            if key in (EBML, SEGMENT):
                return start  # the next file of a chain
            if key == CLUSTER:
                a = cluster(start, x, min(y, b), unknown)
                if y > b:
                    raise Truncated
                continue
            if y > b:
                raise Truncated
            if key == INFO:
                while x < y:
                    inner, p, q, _ = _element(data, x, y)
                    if q > y:
                        raise Truncated
                    if inner == SCALE:
                        scale = _uint(data, p, q)
                    x = q
            elif key in (TRACKS, CUES):
                want, read = (TRACK_ENTRY, track_entry) if key == TRACKS else (CUE_POINT, cue_point)
                while x < y:
                    inner, p, q, _ = _element(data, x, y)
                    if q > y:
                        raise Truncated
                    if inner == want:
                        read(p, q)
                    x = q
            a = y
        return a

    try:
        key, a, b, _ = _element(data, 0, end)
        if key != EBML or b > end:
            raise Truncated
        at = b
        while at < end:
            key, a, b, _ = _element(data, at, end)
            if key == SEGMENT:
                top[:] = [a]
                at = segment(a, min(b, end))
                if b > end:
                    raise Truncated
            else:
                if b > end:
                    raise Truncated
                at = b
    except Truncated:
        complete = False
    out = []
    for track, time, duration, keyframe, position, nth, k, offset, size, count in rows:
        kind, codec, default = tracks.get(track, (None, None, None))
        each = default if duration is None else duration * scale // count
        at = time * scale + k * (each or 0)
        if not -_LONG <= at <= _LONG or (each or 0) > _LONG:
            return out, False
        out.append((track, kind, codec, at, each, keyframe, position, nth, k, offset, size, (track, position, time) in cues))
    return out, complete


# --------------------------------------------------------------------- writing
def _size(n: int) -> bytes:
    for k in range(1, 9):
        if n < _MASK[k]:
            return (n | 1 << 7 * k).to_bytes(k, "big")
    raise ValueError(n)


def _make(key: int, content: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(key: int, n: int) -> bytes:
    return _make(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    if not kind:
        return frames[0]
    out = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        out += _size(len(frames[0]))
        for before, f in zip(frames[:-2], frames[1:-1], strict=True):
            step = len(f) - len(before)
            n = next(n for n in range(1, 9) if abs(step) < _MASK[n] >> 1)
            out += (step + (_MASK[n] >> 1) | 1 << 7 * n).to_bytes(n, "big")
    return out + b"".join(frames)


def write(lines: list[bytes], lacing: bool = True) -> bytes:
    """A file with one frame a line: track 1 the lines, track 2 each cluster's number.

    Lines follow each other by ``FRAME_MS``. Where ``lacing`` is set, up to four lines
    share a block: equally long ones without sizes, else Xiph or EBML sizes in turn.
    Every cluster's first block is cued.
    """
    head = _make(EBML, _make(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = _make(INFO, _number(SCALE, 1_000_000) + _make(0x4D80, b"lithic") + _make(0x5741, b"lithic"))
    text = _number(TRACK_NUMBER, 1) + _number(TRACK_TYPE, 17) + _make(CODEC, b"S_TEXT/UTF8") + _number(DEFAULT_DURATION, FRAME_MS * 1_000_000)
    meta = _number(TRACK_NUMBER, 2) + _number(TRACK_TYPE, 33) + _make(CODEC, b"D_WEBVTT/METADATA")
    body = [info, _make(TRACKS, _make(TRACK_ENTRY, text) + _make(TRACK_ENTRY, meta))]
    place, cues = sum(map(len, body)), []
    for c, first in enumerate(range(0, len(lines), CLUSTER_LINES)):
        own = lines[first : first + CLUSTER_LINES]
        blocks = [_number(TIMESTAMP, first * FRAME_MS)]
        k = turn = 0
        while k < len(own):
            frames = own[k : k + 4] if lacing and turn % 2 else own[k : k + 1]
            kind = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 1 if turn % 4 == 1 else 3
            block = b"\x81" + (k * FRAME_MS).to_bytes(2, "big") + bytes([128 | kind << 1]) + _laced(frames, kind)
            blocks.append(_make(SIMPLE_BLOCK, block))
            k, turn = k + len(frames), turn + 1
        note = b"\x82\x00\x00\x00" + str(c).encode()
        blocks.append(_make(BLOCK_GROUP, _make(BLOCK, note) + _number(DURATION, len(own) * FRAME_MS)))
        cues.append(_make(CUE_POINT, _number(CUE_TIME, first * FRAME_MS) + _make(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, place))))
        body.append(_make(CLUSTER, b"".join(blocks)))
        place += len(body[-1])
    return head + _make(SEGMENT, b"".join(body) + (_make(CUES, b"".join(cues)) if cues else b""))


# ------------------------------------------------------------------- DataFrames
def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in batches_of([len(t or "") for t in texts], CHUNK):
            made = [None if t is None else write([x.encode() for x in t.split("\n")] if t else []) for t in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(made, pa.binary())], ["doc_id", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as a Matroska file; a NULL text gives NULL."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_write_batches, "doc_id long, media binary")


PACKETS = (
    "doc_id long, complete boolean, track long, track_type int, codec string, timestamp_ns long, duration_ns long, "
    "keyframe boolean, cluster long, block int, frame int, offset long, size long, cued boolean"
)
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
_NAMES = [x.split()[0] for x in PACKETS.split(", ")]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, media = batch.column("doc_id"), batch.column("media")
        for lo, hi in batches_of([len(x.as_buffer()) if x.is_valid else 0 for x in media], CHUNK):
            owner, flags, rows = [], [], []
            for k in range(lo, hi):
                if not media[k].is_valid:
                    continue
                packets, complete = parse(media[k].as_py())
                owner += [k] * len(packets)
                flags += [complete] * len(packets)
                rows += packets
            cols = list(zip(*rows, strict=True)) or [[] for _ in _NAMES[2:]]
            arrays = [ids.take(pa.array(owner, pa.int64())), pa.array(flags, pa.bool_())]
            arrays += [pa.array(c, t) for c, t in zip(cols, _TYPES[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)


def matroska_packets(files: DataFrame) -> DataFrame:
    """One row for every frame of every file of ``files`` (doc_id, media).

    ``cluster`` is the cluster's position in its segment, ``block`` the block's
    number in it, ``frame`` the frame's in the block; ``offset`` and ``size`` are the
    payload's byte range in the file. No shuffle.

    * A NULL or empty file, and one that isn't EBML, has no packets.
    * A truncated or broken file, and one with numbers that don't fit their columns,
      gives the packets before the fault, with ``complete`` false. Unknown sizes, unknown elements and unlisted tracks
      are read; the latter have a NULL type and codec.
    * NULL and repeated doc_ids and repeated rows are parsed row by row. ``doc_id``
      must be a number.
    * Files of any length are read whole. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    rows = only(files, "doc_id", "media").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    return rows.mapInArrow(_parse_batches, PACKETS)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of all documents, each made into a Matroska file."""
    return matroska_packets(text_media(documents(spark, sf_dir)))
