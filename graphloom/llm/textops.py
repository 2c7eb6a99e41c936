"""Vectorised word and window hashing over UTF-8 bytes.

Words are maximal runs of bytes outside space and 0x09-0x0D, which for UTF-8 are the code-point runs
``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits: a polynomial over the bytes modulo 2**64, then a bit mixer.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        m = max(n, _CHUNK + 1)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            t = np.full(m, base, dtype=U64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=U64)
    return _powers["p"], _powers["q"]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words of a uint8 array."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; the work arrays stay as small as a chunk (or the longest word)."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        seg = buf[base : int(ends[j - 1])]
        p, q = _power_tables(len(seg))
        g = np.empty(len(seg) + 1, dtype=U64)
        g[0] = 0
        np.cumsum((seg.astype(U64) + U64(1)) * p[: len(seg)], out=g[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64((g[b] - g[a]) * q[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(h: np.ndarray, k: int, seed: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = np.zeros(n, dtype=U64)
    m = U64(seed | 1)
    for j in range(k):
        acc = acc * m + h[j : j + n]
    return mix64(acc)


def cover(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Boolean mask of the positions below ``n`` covered by windows of ``width`` at ``starts``."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def ascii_lower(data: bytes) -> bytes:
    return data.lower()  # bytes.lower touches A-Z only
