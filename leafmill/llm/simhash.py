"""SimHash fingerprints from sign sums of shingle hashes."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0xD6E8FEB86659FD93)  # fixed odd multiplier
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a code-point array; shorter arrays have one."""
    codes = codes.astype(np.uint64)
    if len(codes) == 0:
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(codes))
    h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k] + np.uint64(1)
    return mix(h)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 / -1 of each of the 64 bits, one row a hash (int8)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int8) << 1) - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Bit sums (rows x 64) to 64-bit fingerprints."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
