"""Numbering of words within a block of documents, and compact forms in which numbers travel."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import zstandard


def numbering() -> defaultdict:
    """A dict that numbers what it is asked for, in the order of the first questions."""
    found: defaultdict = defaultdict()
    found.default_factory = found.__len__
    return found


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32 as planes of their lowest to highest bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(planes), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def packed_firsts(numbers: np.ndarray, base: int) -> bytes:
    """Numbers of which those from ``base`` on appear in order: 0 where one is new, else the number plus 1."""
    before = np.maximum.accumulate(np.concatenate([[base - 1], numbers]))[:-1]
    return packed(np.where(numbers > before, 0, numbers + 1))


def unpacked_firsts(planes: bytes, base: int) -> np.ndarray:
    numbers = unpacked(planes) - 1
    new = numbers < 0
    numbers[new] = base + np.arange(new.sum())
    return numbers


def parts_of(hashes: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) for each part that has any: the places, ascending, of the hashes (uint64) dealt to it."""
    of = hashes % np.uint64(parts)
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    return [(int(p), own) for p, own in zip(found, np.split(order, starts[1:]), strict=False)]
