"""Words of a text as numbers: A-Z lower-cased, split at ASCII white space, hashed all at once from running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts go in pieces that end between words.
PIECE = 1 << 20
_rng = np.random.default_rng(20)
#: A number for each byte, and the powers of an odd base and of its inverse (modulo 2^64) by position.
_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers 0 to ``n`` at least, of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(12, n.bit_length())
        grow = lambda base: np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, base, dtype=np.uint64)]), dtype=np.uint64)
        _powers[:] = [grow(_BASE), grow(pow(_BASE, -1, 1 << 64))]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, a polynomial in its bytes; and its last two bytes as a number (the last counts 256)."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers_to(len(raw))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_CODE[raw] * up[: len(raw)], dtype=np.uint64)])
    last = raw[end - 1].astype(np.int64) * 256
    last += np.where(end - begin > 1, raw[np.maximum(end - 2, 0)], 0)
    return mixed((sums[end] - sums[begin]) * down[begin]), last


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def hashes_of(text: str | None) -> np.ndarray:
    return np.concatenate([word_hashes(x)[0] for x in _pieces((text or "").encode())])


def hashes_and_endings(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    both = [word_hashes(x) for x in _pieces((text or "").encode())]
    return np.concatenate([h for h, _ in both]), np.concatenate([e for _, e in both])
