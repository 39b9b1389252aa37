"""Token ids as binary columns: patched frame-of-reference blocks.

The ids of a document are cut into blocks of ``BLOCK``. A block stores its
minimum, and of every id the difference to it in a width that is enough for
``PERCENTILE`` of them; what the others have above that width is in a list of
exceptions. Where each block starts is in an index, so one block can be decoded
without the ones before it.

Block: minimum (uint32), count - 1, width, exceptions, bytes of an exception's
high part (uint8 each); packed differences, the first in the lowest bits of
little-endian 64-bit words, cut after the last byte used; positions of the
exceptions (uint8); their high parts (little-endian).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, documents, only
from .tokens import TOKENIZER, encoder

BLOCK = 128
PERCENTILE = 0.9
HEADER = 8
CHUNK = 1 << 20


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each value below 2^32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2^width, as rows of 16 * width bytes."""
    words = np.zeros((max(1, 2 * width), len(values)), np.uint64)
    cols = np.ascontiguousarray(values.T.astype(np.uint64))
    for i in range(BLOCK if width else 0):
        at, shift = divmod(i * width, 64)
        words[at] |= cols[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= cols[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[: 2 * width].T).view(np.uint8).reshape(len(values), 16 * width)


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """``count`` values of ``width`` bits."""
    if not width:
        return np.zeros(count, np.uint64)
    words = np.frombuffer(data + bytes(-len(data) % 8 + 8), "<u8")
    bit = np.arange(count, dtype=np.uint64) * np.uint64(width)
    at, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    high = np.where(shift > 0, words[at + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[at] >> shift) | high) & np.uint64((1 << width) - 1)


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of several documents' ids, which follow each other in ``ids``.

    Returns all bytes, the bytes of each document, the start of every block in
    its document, and the blocks of each document.
    """
    blocks = -(-sizes // BLOCK)
    n = int(blocks.sum())
    if not n:
        zero = np.zeros(len(sizes), np.int64)
        return np.zeros(0, np.uint8), zero, np.zeros(0, np.int64), blocks
    owner = np.repeat(np.arange(len(sizes)), blocks)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(n) - first[owner]
    begin = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
    count = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
    lane = np.arange(BLOCK)
    real = lane < count[:, None]
    grid = ids[np.minimum(begin[:, None] + lane, len(ids) - 1)].astype(np.uint32)
    low = np.where(real, grid, np.uint32(0xFFFFFFFF)).min(axis=1)
    delta = np.where(real, grid - low[:, None], np.uint32(0))
    bits = _bit_length(delta)
    rank = np.sort(bits, axis=1)  # the padding is 0 and sorts first
    width = rank[np.arange(n), BLOCK - count + np.ceil(count * percentile).astype(np.int64) - 1]
    over = bits > width[:, None]
    exceptions = over.sum(axis=1)
    high = (bits.max(axis=1).astype(np.int64) - width + 7) // 8 * (exceptions > 0)
    high = np.where(high == 3, 4, high)
    packed = (count * width.astype(np.int64) + 7) // 8
    length = HEADER + packed + exceptions * (1 + high)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    head = np.zeros((n, HEADER), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5], head[:, 6], head[:, 7] = count - 1, width, exceptions, high
    out[start[:, None] + np.arange(HEADER)] = head
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if not w:
            continue
        rows = pack(delta[own] & np.uint32((1 << int(w)) - 1), int(w))
        to = (start[own] + HEADER)[:, None] + np.arange(rows.shape[1])
        whole = packed[own] == rows.shape[1]
        out[to[whole]] = rows[whole]
        for k in np.flatnonzero(~whole):
            size = packed[own[k]]
            out[to[k, :size]] = rows[k, :size]
    row, col = np.nonzero(over)
    if len(row):
        at = np.arange(len(row)) - np.searchsorted(row, row)
        base = start[row] + HEADER + packed[row]
        out[base + at] = col
        value = delta[row, col].astype(np.uint64) >> width[row].astype(np.uint64)
        for byte in range(4):
            has = high[row] > byte
            to = base[has] + exceptions[row[has]] + at[has] * high[row[has]] + byte
            out[to] = (value[has] >> np.uint64(8 * byte)) & np.uint64(255)
    bytes_of = np.bincount(owner, length, len(sizes)).astype(np.int64)
    return out, bytes_of, start - (np.cumsum(bytes_of) - bytes_of)[owner], blocks


def decode_block(data: bytes, start: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block that starts at ``start``, and where the next starts."""
    low = int.from_bytes(data[start : start + 4], "little")
    count, width, exceptions, high = data[start + 4] + 1, data[start + 5], data[start + 6], data[start + 7]
    at = start + HEADER
    size = (count * width + 7) // 8
    values = unpack(data[at : at + size], width, count)
    at += size
    for k in range(exceptions):
        part = at + exceptions + k * high
        values[data[at + k]] |= np.uint64(int.from_bytes(data[part : part + high], "little") << width)
    return (values + np.uint64(low)).astype(np.uint32), at + exceptions * (1 + high)


def decode(data: bytes) -> np.ndarray:
    """All ids of a document."""
    out, at = [np.zeros(0, np.uint32)], 0
    while at < len(data):
        ids, at = decode_block(data, at)
        out.append(ids)
    return np.concatenate(out)


def _writer(path: str, percentile: float):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in batches_of([len(t or "") for t in texts], CHUNK):
                null = np.array([t is None for t in texts[lo:hi]])
                ids, sizes = enc.encode([t or "" for t in texts[lo:hi]])
                data, size, starts, blocks = encode_blocks(ids, sizes, percentile)
                offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32)
                valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
                blob = pa.Array.from_buffers(pa.large_binary(), hi - lo, [valid, pa.py_buffer(offset.tobytes()), pa.py_buffer(data.tobytes())])
                index = pa.ListArray.from_arrays(pa.array(first), pa.array(starts.astype(np.int32)), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, mask=null), index, blob.cast(pa.binary())],
                    ["doc_id", "n_tokens", "block_starts", "data"],
                )

    return write


def token_id_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, n_tokens, block_starts, data) of every row of ``docs``.

    ``data`` holds the ids of the whole text in patched frame-of-reference
    blocks, ``block_starts`` the byte at which each begins. No shuffle.

    * A NULL text gives NULLs, an empty one 0 tokens, no blocks and empty data.
    * NULL and repeated doc_ids, and repeated rows, are kept as they are.
    * Texts of any length are encoded whole. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_writer(tokenizer, percentile), "doc_id long, n_tokens long, block_starts array<int>, data binary")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as binary blocks."""
    return token_id_blocks(documents(spark, sf_dir))
