"""CRC-32 arithmetic on arrays: what a checksum becomes when bytes follow."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = np.uint64(0xEDB88320)  # the reflected polynomial of zlib's crc32


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo the CRC's."""
    a, b = np.broadcast_arrays(a.astype(np.uint64), b.astype(np.uint64))
    out, b = np.zeros(a.shape, np.uint64), b.copy()
    for k in range(31, -1, -1):
        out ^= b * ((a >> np.uint64(k)) & np.uint64(1))
        b = (b >> np.uint64(1)) ^ (_POLYNOMIAL * (b & np.uint64(1)))
    return out


def crc_shift(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The part that data with checksum crc has in the checksum of the data and following more bytes. The checksum of
    parts joined is the xor of those of each part with the number of bytes after it."""
    out = np.asarray(crc).astype(np.uint64)
    n = np.asarray(following).astype(np.int64)
    power = np.array([1 << 23], np.uint64)  # x ** 8, one byte
    while n.any():
        odd = np.flatnonzero(n & 1)
        out[odd] = _times(power, out[odd])
        n, power = n >> 1, _times(power, power)
    return out
