"""Vectorised word hashing over Arrow string columns.

Texts are handled as one UTF-8 byte array per chunk. A word's hash mixes its bytes, eight at a time, under
a key of the run (words of over 64 bytes are hashed by keyed BLAKE2b), so texts cannot be made to collide.
An n-gram's hash mixes those of the two longest power-of-two runs of words that cover it, and theirs are
built by doubling: nothing in it is linear, so repetitive word sequences do not cancel out either.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19

IS_WORD_SPACE = np.ones(256, bool)
IS_WORD_SPACE[list(_SPACE)] = False

#: Letters, digits and everything beyond ASCII.
IS_WORD_ALNUM = np.zeros(256, bool)
IS_WORD_ALNUM[0x30:0x3A] = IS_WORD_ALNUM[0x41:0x5B] = IS_WORD_ALNUM[0x61:0x7B] = IS_WORD_ALNUM[0x80:] = True

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_KEYS: dict[str, int] = {}


def run_key(spark) -> int:
    """The key of this run's word hashes: drawn at random on the driver, the same in all its tasks, not to be guessed from outside."""
    return _KEYS.setdefault(spark.sparkContext.applicationId, int.from_bytes(os.urandom(8), "little"))


#: Bytes of words that are mixed eight at a time.
LANES = 8
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Hashes of the byte ranges of ``data``."""
    lengths = ends - starts
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))  # the eight bytes from each place on
    out = mix(lengths.astype(U64) ^ U64(key))
    live = np.arange(len(starts))
    for lane in range(LANES):
        if lane:
            live = live[lengths[live] > 8 * lane]
            if not len(live):
                return out
        bytes_ = eight[starts[live] + 8 * lane] & _MASKS[np.minimum(lengths[live] - 8 * lane, 8)]
        out[live] = mix(out[live] ^ bytes_)
    secret = key.to_bytes(8, "little")
    for i in live[lengths[live] > 8 * LANES].tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


class Chunk:
    """Words of consecutive texts: ``hashes`` of all words, ``first[i]:first[i+1]`` those of text i of the chunk."""

    def __init__(self, rows: slice, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray):
        self.rows, self.hashes, self.first, self.starts, self.ends, self.data = rows, hashes, first, starts, ends, data
        self._runs = [hashes]

    def grams(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of word sequences start..end-1 (positions in ``hashes``), none empty; the same wherever a sequence stands."""
        n = (end - start).astype(np.int64)
        if not len(n):
            return np.zeros(0, U64)
        level = np.frexp(n.astype(float))[1] - 1  # 2**level words, twice, cover the sequence
        while len(self._runs) <= int(level.max()):
            k = len(self._runs)
            below, half = self._runs[-1], 1 << (k - 1)
            own = np.zeros(len(below), U64)
            own[: max(0, len(below) - half)] = mix(below[: max(0, len(below) - half)] * U64(0xD1342543DE82EF95) + below[half:] + U64(k))
            self._runs.append(own)
        if int(level.min()) == int(level.max()):
            runs, wide = self._runs[int(level[0])], 1 << int(level[0])
            left, right = runs[start], runs[end - wide]
        else:
            left, right = np.empty(len(n), U64), np.empty(len(n), U64)
            for k in np.unique(level).tolist():
                at = level == k
                left[at], right[at] = self._runs[k][start[at]], self._runs[k][end[at] - (1 << k)]
        return mix(mix(left + n.astype(U64)) * U64(0xA24BAED4963EE407) + right)

    def starts_of(self, n: int) -> np.ndarray:
        """Positions at which n words of one text start."""
        counts = np.maximum(np.diff(self.first) - (n - 1), 0)
        at = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return at + np.arange(len(at))


def column_view(col: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(bytes, offsets) of a string column, not copied; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return memoryview(buffers[2]) if buffers[2] is not None else memoryview(b""), offsets


def chunks(col: pa.Array, lower: bool, is_word: np.ndarray = IS_WORD_SPACE, key: int = 0) -> Iterator[Chunk]:
    """Hash the words of a string column, about CHUNK_BYTES at a time (a longer text makes a chunk of its own)."""
    view, offsets = column_view(col)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        lo, hi = offsets[at], offsets[to]
        raw = view[lo:hi]
        own = np.frombuffer(bytes(raw).translate(LOWER) if lower else raw, np.uint8)
        word = is_word[own]
        # edge[i]: a word starts or ends before byte i; a text's border always separates
        before = np.empty(len(own) + 1, bool)
        before[0], before[1:] = False, word
        after = np.empty(len(own) + 1, bool)
        after[-1], after[:-1] = False, word
        border = np.zeros(len(own) + 1, bool)
        border[offsets[at : to + 1] - lo] = True
        starts = np.flatnonzero(after & (~before | border))
        ends = np.flatnonzero(before & (~after | border))
        hashes = hash_words(own, starts, ends, key)
        first = np.searchsorted(starts, offsets[at : to + 1] - lo)
        yield Chunk(slice(at, to), hashes, first, starts, ends, own)
        at = to


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one function held at its peak would stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """Wrap a function over batches so that its worker gives memory back when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
