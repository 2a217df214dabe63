"""Many texts at once: the texts of an Arrow batch are joined into slabs of bounded size and cut by tables of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .words import _CODE, _powers_to, mixed

#: Bytes of a slab. A longer text comes in parts, each of which ends before a byte that is no part of a word.
SLAB = 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Codes of a second, independent hash.
OTHER_CODE = np.random.default_rng(21).integers(1, 2**64, 256, dtype=np.uint64)


class Slab(NamedTuple):
    """Bytes, the numbers of the texts in them, where each begins, and whether the first begins here (else it goes on)."""

    raw: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    fresh: bool


def slabs(texts: list[bytes], gap: np.ndarray, most: int = SLAB, between: bytes = b"\n") -> Iterator[Slab]:
    """``texts`` in order, ``between`` them a byte that ends words and passages."""
    held: list[bytes] = []
    first = size = 0

    def give(data: bytes, rows: np.ndarray, starts: np.ndarray, fresh: bool = True) -> Slab:
        return Slab(np.frombuffer(data, dtype=np.uint8), rows, starts, fresh)

    def joined(upto: int) -> Slab:
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held[:-1]])]).astype(np.int64)
        return give(between.join(held), np.arange(first, upto), starts)

    for k, text in enumerate(texts):
        if held and size + len(text) > most:
            yield joined(k)
            held, size = [], 0
        if len(text) <= most:
            if not held:
                first = k
            held.append(text)
            size += len(text) + 1
            continue
        raw, at = np.frombuffer(text, dtype=np.uint8), 0
        while at < len(text):
            cut = min(at + most, len(text))
            while cut < len(text) and not gap[raw[cut]]:
                ends = np.flatnonzero(gap[raw[cut : cut + most]])
                cut = cut + int(ends[0]) if len(ends) else min(cut + most, len(text))
            yield give(text[at:cut], np.array([k]), np.zeros(1, dtype=np.int64), at == 0)
            at = cut
    if held:
        yield joined(len(texts))


def spans(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that aren't in ``gap`` begin and end."""
    out = np.concatenate([[True], gap[raw], [True]])
    edge = np.flatnonzero(out[1:] != out[:-1])
    return edge[::2], edge[1::2]


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """A 64-bit hash of each span, all at once from running sums."""
    up, down = _powers_to(len(raw))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(code[raw] * up[: len(raw)], dtype=np.uint64)])
    return mixed((sums[end] - sums[begin]) * down[begin])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def gathered(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given stretches of ``data`` one after another, and their offsets."""
    offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(length, dtype=np.int64)])
    return data[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def ranges(n: int, most: int) -> Iterator[slice]:
    """0..n in pieces of ``most``."""
    return (slice(k, min(n, k + most)) for k in range(0, n, most))
