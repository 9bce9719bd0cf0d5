"""Text columns as numpy arrays: Arrow batches cut into chunks, words, hashes and code points without a Python loop per character."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

#: What the C library's mallopt calls the size from which blocks are mapped and go back to the system when freed.
_M_MMAP_THRESHOLD = -3


@lru_cache(1)
def _c_library() -> ctypes.CDLL | None:
    """The C library, told to map large arrays each on its own; None where it has no such call."""
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(_M_MMAP_THRESHOLD, 1 << 20)
        library.malloc_trim(0)
        return library
    return None


def tidy(run: Callable) -> Callable:
    """The same batch function; at the end of a partition its worker, which stays for other tasks, gives freed memory back."""

    def inner(batches):
        library = _c_library()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if library is not None:
            library.malloc_trim(0)

    return inner


_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of more bytes are hashed one by one by a digest.
LONG_SPAN = 64

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
        col = col.cast(pa.string()) if not pa.types.is_string(col.type) else col
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def chunks(col: pa.Array, limit: int = CHUNK_BYTES, rows: int = 32768) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets from 0) of pieces of about `limit` bytes and at most `rows` whole rows."""
    if not len(col):
        return
    raw, offs = string_buffers(col)
    first = 0
    while first < len(col):
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(col), first + rows)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, that doesn't depend on its place.

    Spans are taken in blocks of eight bytes from their start, each mixed into what came before; of spans of one length up to eight bytes no two
    have the same hash. Longer ones than LONG_SPAN go through BLAKE2b, of which there are at most len(data) / LONG_SPAN in words that don't overlap.
    """
    sizes = (ends - starts).astype(np.int64)
    out = mix((sizes.astype(np.uint64) + np.uint64(1)) * _P)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    long = np.flatnonzero(sizes > LONG_SPAN)
    if len(long):
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at, size = starts[left], sizes[left]
    while len(left):
        block = blocks[at] & _KEEP[np.minimum(size, 8)]
        out[left] = mix((out[left] ^ block) + _P)
        more = size > 8
        left, at, size = left[more], at[more] + 8, size[more] - 8
    return out


def doc_starts(offs: np.ndarray, n: int) -> np.ndarray:
    """True at the byte where a row begins."""
    at = np.zeros(n + 1, bool)
    at[offs[:-1]] = True
    return at[:n]


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each maximal run of word bytes within a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[data]
    begins = inside.copy()
    new = doc_starts(offs, len(data))
    begins[1:] &= ~inside[:-1] | new[1:]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | new[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(offs, starts, "right") - 1, starts, ends


@lru_cache(1)
def letter_or_digit_bytes() -> np.ndarray:
    """The word bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z: a-z, 0-9 and all of non-ASCII."""
    t = np.zeros(256, bool)
    t[ord("0") : ord("9") + 1] = t[ord("a") : ord("z") + 1] = True
    t[128:] = True
    return t


@lru_cache(1)
def non_space_bytes() -> np.ndarray:
    """The word bytes of `[^\\x20\\x09-\\x0D]`."""
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


@lru_cache(1)
def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return _lower_table()[data]


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of a chunk of valid UTF-8."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offs]


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of values[offs[i]:offs[i+1]] for each i; 0 for empty ones."""
    out = np.zeros((len(offs) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offs[:-1][full], axis=0, dtype=out.dtype)
    return out
