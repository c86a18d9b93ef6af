"""Vectorised word splitting and hashing over Arrow string columns.

Words are runs of bytes outside a separator set (all separators here are ASCII,
so UTF-8 bytes may be classified one by one).  A word's 64-bit hash takes in its
length, then eight bytes at a time, with a bijective mixing step after each; long
words are hashed by BLAKE2.  Other seeds give independent hashes.  Sequences of a
few words hash by a polynomial over the (mixed) word hashes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20  # powers that are made at once, at least
CHUNK = 4 << 20  # bytes of text handled at once, whole documents
LONG = 64  # bytes of a word that are mixed in eight at a time; longer words go to BLAKE2

#: What a block of eight bytes keeps of its last 0 to 8.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it


def relieve() -> None:
    """Gives memory that Arrow's and the C library's allocators keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that lives on: what one batch took is not held while the next ones, or other tasks, run."""

    @wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            relieve()
        relieve()

    return leaner


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        array = array.cast(pa.large_binary())
    else:
        array = array.cast(pa.large_string()).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    n = len(array)
    off = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK):
    """(first document, bytes, offsets) of runs of whole documents of about limit bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def split(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the words in buf."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~sep[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed))
    if not len(size):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    rows, at, left = np.arange(len(size)), starts, size
    if size.max() > LONG:
        rows = np.flatnonzero(size <= LONG)
        at, left, key = starts[rows], size[rows], seed.to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    h = out[rows]
    while len(h):
        h = mix(h ^ (eight[at] & KEEP[np.minimum(left, 8)]))
        more = left > 8
        done = rows[~more]
        out[done] = h[~more]
        rows, at, left, h = rows[more], at[more] + 8, left[more] - 8, h[more]
    return out


def sequences(words: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of every n consecutive words; the caller leaves out those that cross documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(base) + words[k : k + m]
    return mix(out)
