"""Token ids of whole texts with the public vocabularies, in vectorised batches.

For rank files the text is cut where the split pattern always ends a piece
(after a run of letters, and before a run of white space), so that a chunk has
the same ids wherever it stands. Chunks are looked up by a 64-bit hash in a
table of fixed size and only those that aren't there are encoded; the hash is
taken over the code points, so different chunks share one with a probability of
about 1e-19 a pair.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np

from .common import batches_of, codepoints, prefix_sums, span_hash

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 17
SLOTS = 21
POOL = 1 << 23
#: Longer chunks aren't kept in the table.
LONGEST = 64
_LOADED: dict = {}
_CACHE: dict = {}


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 other, by code point."""
    if "classes" not in _CACHE:
        import regex

        table = np.full(0x110000, 2, np.uint8)
        chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        table[[ord(c) for c in regex.findall(r"\p{L}", chars)]] = 1
        table[[ord(c) for c in regex.findall(r"\s", chars)]] = 0
        _CACHE["classes"] = table
    return _CACHE["classes"]


class Encoder:
    """Ids of texts for one vocabulary file; special tokens count as plain text."""

    def __init__(self, path: str):
        self.path = path
        self.version = tokenizer_version(path)
        self._table = None
        if path.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            self._rank = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self._encode = None
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self._encode = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no tokenizer library for {path}")

    # ------------------------------------------------------------- plain path
    def encode_plain(self, text: str) -> list[int]:
        """Ids by the library alone; the vectorised path must give the same."""
        return self._rank.encode_ordinary(text) if self._encode is None else list(self._encode([text])[0])

    # -------------------------------------------------------- vectorised path
    def _reset(self) -> None:
        n = 1 << SLOTS
        self._table = (np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32))
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, ids: np.ndarray) -> int:
        at = self._used
        while at + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[at : at + len(ids)] = ids
        self._used += len(ids)
        return at

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every chunk: the text it is in, where its ids are in the pool, how many."""
        arr, starts = codepoints(texts)
        ends = np.append(starts[1:], len(arr)) - 1
        cls = _classes()[np.minimum(arr, 0x10FFFF)]
        cls[ends] = 3
        begin = np.empty(len(arr), bool)
        begin[0] = True
        begin[1:] = ((cls[:-1] == 1) & (cls[1:] != 1)) | ((cls[1:] == 0) & (cls[:-1] != 0))
        begin[starts] = begin[ends] = True
        at = np.flatnonzero(begin)
        stop = np.append(at[1:], len(arr))
        real = cls[at] != 3
        at, stop = at[real], stop[real]
        where = np.searchsorted(starts, at, "right") - 1
        if not len(at):
            return where, at, at
        key = span_hash(prefix_sums(arr), at, stop) | np.uint64(1)
        if self._table is None or self._used > POOL:
            self._reset()
        keys, offs, lens = self._table
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int64)
        off, n = offs[slot], lens[slot]
        miss = np.flatnonzero(keys[slot] != key)
        if len(miss):
            fresh, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            joined = "\0".join(texts) + "\0"
            a, b = at[miss[first]].tolist(), stop[miss[first]].tolist()
            encode = self._rank.encode_ordinary
            found = [encode(joined[i:j]) for i, j in zip(a, b, strict=True)]
            size = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(size.sum()))
            new = self._add(flat) + np.cumsum(size) - size
            off[miss], n[miss] = new[back], size[back]
            keep = np.array(b) - np.array(a) <= LONGEST
            to = (fresh[keep] >> np.uint64(64 - SLOTS)).astype(np.int64)
            # where two share a slot the last one has it, in all three arrays
            keys[to], offs[to], lens[to] = fresh[keep], new[keep], size[keep]
        return where, off, n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        if self._encode is not None:
            for lo, hi in batches_of(map(len, texts), CHUNK):
                out[lo:hi] = [len(x) for x in self._encode(texts[lo:hi])]
            return out
        for lo, hi in batches_of(map(len, texts), CHUNK):
            where, _, n = self._chunks(texts[lo:hi])
            out[lo:hi] = np.bincount(where, n, hi - lo).astype(np.int64)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in batches_of(map(len, texts), CHUNK):
            if self._encode is not None:
                found = self._encode(texts[lo:hi])
                parts += [np.array(x, np.uint32) for x in found]
                sizes.append(np.array([len(x) for x in found], np.int64))
                continue
            where, off, n = self._chunks(texts[lo:hi])
            total = np.cumsum(n, dtype=np.int64)
            idx = np.repeat(off - (total - n), n) + np.arange(total[-1] if len(total) else 0)
            parts.append(self._pool[idx])
            sizes.append(np.bincount(where, n, hi - lo).astype(np.int64))
        return np.concatenate(parts), np.concatenate(sizes)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file; other files, other counts."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


def encoder(path: str = TOKENIZER) -> Encoder:
    """The encoder of a file, once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
