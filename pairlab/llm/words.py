"""Vectorised word scanning over Arrow string batches.

Words are runs of ``[^\\x20\\x09-\\x0D]`` (ASCII white space splits; everything
else, also other Unicode spaces, is part of a word).  The scan works on the
UTF-8 bytes of a whole batch at once: no Python object per word.

A word is identified by a 64-bit polynomial hash of its bytes (random odd base
and random byte values, then mixed).  Two different words of a corpus with
``v`` distinct words collide with probability about ``v**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes scanned at once; bounds the temporaries (a longer text is scanned alone)
CHUNK_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUES_LOWER = _VALUES[LOWER]
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_TABLES.get("pow", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, b in (("pow", _BASE), ("inv", _INV)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            _TABLES[name] = np.cumprod(t, dtype=np.uint64)
    return _TABLES["pow"], _TABLES["inv"]


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.type != pa.large_string():
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of the texts ``lo .. lo+n`` of a batch.

    ``first[i]:first[i+1]`` are the words of text ``i``; ``start``/``end`` are
    byte positions in ``data`` and ``offsets`` those of the texts.
    """
    lo: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first index per text of the runs of bytes where ``inside`` is true."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first index per text of the runs outside ``space``."""
    return runs(~space[data], offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span."""
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_VALUES_LOWER if lower else _VALUES)[data] * power[:len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def scan(arr: pa.Array | pa.ChunkedArray, lower: bool = True, hashed: bool = True) -> Iterator[Words]:
    """Words of a string array, in chunks of whole texts."""
    data, offsets = utf8(arr)
    for lo, d, o in chunks(data, offsets):
        start, end, first = spans(d, o)
        yield Words(lo, d, o, start, end, first, hash_spans(d, start, end, lower) if hashed else None)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (length ``len(h) - k + 1``, empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(_BASE) + h[i:i + n]
    return mix64(out)
