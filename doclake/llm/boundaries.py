"""Sorted sets of places in a text, as containers of the Roaring kind.

Places are split by their upper bits into ranges of 65 536; each range that holds any is one
container: a sorted array, a bitmap, or runs, whichever is smallest. The set keeps the number of
places before each container, so ``select(k)`` (the place with exactly k places before it) is a binary
search for the container and a look-up inside it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BITS = 16
RANGE = 1 << BITS
_WORDS = RANGE // 64


class Array:
    """Few places: the places themselves, two bytes each."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)
        self.size = len(places)

    def select(self, k: int) -> int:
        return int(self.places[k])


class Bitmap:
    """Many places: one bit each, and the number of bits set before every word of 64."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(RANGE, bool)
        bits[places] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.size = len(places)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class Runs:
    """Neighbouring places: first place of each run, and the number of places in earlier runs."""

    def __init__(self, places: np.ndarray, edges: np.ndarray):
        self.first = places[edges].astype(np.uint16)
        self.before = edges
        self.size = len(places)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(places: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of sorted places below ``RANGE``: 2 bytes a place, 8 192 bytes, or 4 bytes a run."""
    n = len(places)
    edges = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    if 4 * len(edges) < min(2 * n, 8 * _WORDS):
        return Runs(places, edges)
    return Array(places) if 2 * n <= 8 * _WORDS else Bitmap(places)


class BoundarySet:
    """Containers in order of their ranges, with cumulative cardinalities."""

    def __init__(self, ranges: Iterable[tuple[int, np.ndarray]]):
        """``ranges``: ascending number of the range, and its sorted places relative to the range's begin."""
        found = [(key, container(places)) for key, places in ranges if len(places)]
        self.keys = [key for key, _ in found]
        self.containers = [c for _, c in found]
        self.before = np.concatenate([[0], np.cumsum([c.size for c in self.containers], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.keys[i] << BITS) + self.containers[i].select(k - int(self.before[i]))
