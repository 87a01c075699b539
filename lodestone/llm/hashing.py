"""Hashes of words and of runs of words for whole batches of texts, with numpy.

A word's hash is 64 bits: a sum over its bytes of random multipliers by place, then mixed, so two
different words agree with a chance of about 2^-60.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_MULTIPLIERS = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z lower-cased, of all texts in order; and each text's words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    lengths = ends - starts
    place = np.arange(len(data), dtype=np.int64)[~space] - np.repeat(starts, lengths)
    terms = (_LOWER[data[~space]].astype(np.uint64) + U(1)) * _MULTIPLIERS[place % _PLACES]
    if len(lengths) and lengths.max() > _PLACES:
        terms += place.astype(np.uint64) // U(_PLACES) * terms * U(0x9E3779B97F4A7C15)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    last = np.cumsum(lengths)
    hashes = mix(sums[last] - sums[last - lengths] + lengths.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k hashes that begin at each place, as far as k follow."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _MULTIPLIERS[j]
    return mix(out)


def pack(sorted_numbers: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed planes of the bytes of their differences."""
    import pyarrow as pa

    steps = np.diff(sorted_numbers, prepend=U(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed planes of bytes, as many planes as the largest needs."""
    import pyarrow as pa

    c = counts.astype("<u8")
    width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
    planes = np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T[:width])
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    width = data[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(pa.decompress(data[1:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
