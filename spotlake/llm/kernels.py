"""Array kernels over the buffers of an Arrow text column: no Python object per word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and bytes of longer code points parts words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SEGMENT = 4 << 20
_BLOCK = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


def release() -> None:
    """Give freed memory back to the system.  Allocators keep it, so that a worker that waits for its next task would hold the peak of its last."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_POW = _INV = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None:
        _POW, _INV = powers(_P, _BLOCK + 1), powers(_PINV, _BLOCK + 1)
    return (_POW, _INV) if n <= _BLOCK else (powers(_P, n + 1), powers(_PINV, n + 1))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def segments(data: np.ndarray, off: np.ndarray, most: int = SEGMENT):
    """(first row, bytes, offsets) of runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and text number of each word."""
    d = LOWER[data]
    n = len(d)
    if n == 0:
        z = np.zeros(0, np.int64)
        return d, z, z, z
    inside = ~parts[d]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return d, starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hash(d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of d[start:end] for ascending, disjoint spans: a polynomial over the bytes, mixed."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        n = int(ends[j - 1] - base)
        pw, inv = _tables(n)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[d[base : base + n]] * pw[:n], out=h[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def counts_by(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each of n texts has in the ascending array doc, and where they begin."""
    m = np.bincount(doc, minlength=n)
    return m, np.concatenate([[0], np.cumsum(m)[:-1]])


def sums_by(values: np.ndarray, begins: np.ndarray, counts: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of consecutive runs along axis 0, 0 for empty runs."""
    out = np.zeros((len(counts),) + values.shape[1:], dtype or values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, begins[full], axis=0, dtype=out.dtype)
    return out
