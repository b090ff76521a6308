"""Vectorised text kernels shared by the Arrow-backed operators.

A batch of documents is handled as one UTF-8 byte buffer with offsets, so that
splitting, hashing and n-gram hashing are a handful of numpy passes, not a
Python loop over words.  Word separators are exactly ``[\\x20\\x09-\\x0D]``; all
are single bytes in UTF-8, so byte-level splitting equals character-level
splitting.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import zstandard

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 - 0x9E3779B97F4A7C15 % 8 + 5  # 5 mod 8: order 2**62
_BASE_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _U(base), dtype=_U)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lean() -> None:
    """Give freed arrays back to the system at once: without this, glibc keeps
    arrays of up to 32 MB on its heaps, and a worker's footprint is the sum of
    its peaks."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return what this process has freed to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """``run`` for mapInArrow, after whose end a worker gives back what it freed:
    an idle worker keeps nothing of its last task while others need the memory."""

    def call(batches):
        lean()
        yield from run(batches)
        give_back()

    return call


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, offsets) of runs of whole documents of
    about ``limit`` bytes; a longer document is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offset of each document) of all words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _pow(_BASE, len(data)), out=sums[1:])
    x = (sums[ends] - sums[starts]) * _pow(_BASE_INV, len(data) + 1)[starts]
    return mix(x + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes (len - k + 1 of them),
    document borders not respected."""
    m = len(hashes)
    if m < k:
        return np.zeros(0, _U)
    sums = np.zeros(m + 1, _U)
    np.cumsum(hashes * _pow(_BASE, m), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _pow(_BASE_INV, m + 1)[: m - k + 1])


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the word hashes of each range, and of its length."""
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * _pow(_BASE, len(hashes)), out=sums[1:])
    x = (sums[ends] - sums[starts]) * _pow(_BASE_INV, len(hashes) + 1)[starts]
    return mix(x + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def span_hash(hashes: np.ndarray) -> int:
    """Hash of a whole word-hash sequence, of the same family."""
    return int(gram_hashes(hashes, len(hashes))[0])


def starts_within(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, document index) where k words of one document start."""
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    return ragged(word_offsets[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + count - 1."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    out = np.repeat(starts - before, counts)
    out += np.arange(total)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of each ``width`` consecutive values, by doubling."""
    out, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = out[:-step], out[step:]
        out = np.where(x[a] <= x[b], a, b)
        have += step
    return out


def segment_sums(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of each segment; each depends on its own rows alone, to the last bit."""
    out = np.zeros((len(offsets) - 1, rows.shape[1]))
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(rows, offsets[some], axis=0, dtype=float)
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray) -> list[bytes]:
    """For each document its words joined by one space."""
    lengths = ends - starts + 1
    out = np.append(data, np.uint8(32))[ragged(starts, lengths)]
    stops = np.cumsum(lengths)
    out[stops - 1] = 32
    raw = out.tobytes()
    at = np.concatenate(([0], stops))[word_offsets].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def squeeze(x: np.ndarray) -> bytes:
    """Compress an integer array as byte planes."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1) if len(x) else b""


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Compress an ascending uint64 array as differences."""
    return squeeze(np.diff(x, prepend=_U(0)))


def unsqueeze_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, _U), dtype=_U)


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0 .. n-1 of each hash by its high bits: ascending hashes have ascending buckets."""
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
