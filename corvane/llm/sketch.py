"""Relative-error quantile sketches: relative-rank compactors, mergeable across partitions, days and projects.

A sketch is a stack of compactors. A compactor of level h holds items of weight 2**h. When it is over capacity it sorts
itself, protects the items next to the tail of interest (``high=True``: the largest ones) and promotes every second of the
others to level h + 1. How many sections beside the protected half take part follows the number of trailing ones of the
compaction counter, so an item near the protected tail is compacted exponentially rarely. The rank error at rank r of n
is therefore proportional to the distance to the protected tail: |estimate - truth| <= eps * (n - r) for ``high``.

Cases: NaN and null values never enter; an empty sketch has no quantile (null); ties are kept as often as they occur;
n <= capacity is exact; infinities are ordinary values; merging is by levels and keeps the bound.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

SECTIONS = 3  # initial sections of a half buffer
HEAD = struct.Struct("<BBHQQdd")  # high, levels, k, n, coin seed, min, max


def rank_error(k: int, deviations: float = 3.0) -> float:
    """Relative rank error (to the distance from the protected tail) at so many standard deviations."""
    return deviations * (0.0512 / SECTIONS) ** 0.5 / k


class Compactor:
    __slots__ = ("items", "state", "k", "sections")

    def __init__(self, k: int):
        self.items = np.empty(0)
        self.state = 0
        self.k = k
        self.sections = SECTIONS

    def capacity(self) -> int:
        return 2 * self.k * self.sections

    def grow(self) -> None:
        """More, shorter sections once a counter bit is used up: the buffer grows as the square root of the logarithm does."""
        while self.state >= 1 << (self.sections - 1) and self.k > 4:
            smaller = int(round(self.k / 2**0.5 / 2)) * 2
            if smaller < 4:
                break
            self.k, self.sections = smaller, self.sections * 2

    def compact(self, high: bool, odd: int) -> np.ndarray:
        """Take out of the buffer what is not protected; return the half of it that goes up."""
        self.items.sort()
        ones = ((self.state ^ (self.state + 1)) + 1).bit_length() - 1  # trailing ones of the counter, plus one
        keep = self.capacity() // 2 + (self.sections - min(ones, self.sections)) * self.k
        keep = min(keep, len(self.items) - 2)
        take = len(self.items) - keep
        take -= take % 2
        if high:
            low, self.items = self.items[:take], self.items[take:].copy()
        else:
            low, self.items = self.items[len(self.items) - take :], self.items[: len(self.items) - take].copy()
        self.state += 1
        self.grow()
        return low[odd::2]


class RelativeSketch:
    def __init__(self, k: int = 32, high: bool = True, seed: int = 0):
        self.k, self.high, self.n = k, high, 0
        self.low, self.top = np.inf, -np.inf
        self.coin = (seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF
        self.levels: list[Compactor] = [Compactor(k)]

    def flip(self) -> int:
        self.coin = (self.coin * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return self.coin >> 63

    def update(self, values: np.ndarray) -> RelativeSketch:
        values = np.asarray(values, dtype=np.float64)
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.low, self.top = min(self.low, values.min()), max(self.top, values.max())
            self.levels[0].items = np.concatenate([self.levels[0].items, values])
            self.settle()
        return self

    def settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h].items) >= self.levels[h].capacity():
                up = self.levels[h].compact(self.high, self.flip())
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, up])
            h += 1

    def merge(self, other: RelativeSketch) -> RelativeSketch:
        if (self.k, self.high) != (other.k, other.high):
            raise ValueError("sketches of different shape cannot be merged")
        self.n += other.n
        self.low, self.top = min(self.low, other.low), max(self.top, other.top)
        self.coin ^= other.coin << 1 & 0xFFFFFFFFFFFFFFFF
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, its in zip(self.levels, other.levels):
            mine.items = np.concatenate([mine.items, its.items])
            mine.state |= its.state
            if its.sections > mine.sections:
                mine.k, mine.sections = its.k, its.sections
            mine.grow()
        self.settle()
        return self

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([c.items for c in self.levels])
        weights = np.repeat([1 << h for h in range(len(self.levels))], [len(c.items) for c in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def rank(self, value: float) -> int:
        """Estimated number of values <= value."""
        values, ends = self.weighted()
        at = np.searchsorted(values, value, side="right")
        return int(ends[at - 1]) if at else 0

    def quantiles(self, qs: Iterable[float]) -> list[float | None]:
        """The value at rank ceil(q * n), as percentile_disc has it; None of an empty sketch."""
        if not self.n:
            return [None for _ in qs]
        values, ends = self.weighted()
        out = []
        for q in qs:
            target = max(1, int(np.ceil(q * self.n - 1e-9)))
            if target <= 1 or target >= self.n:
                out.append(float(self.low if target <= 1 else self.top))
            else:
                out.append(float(values[min(np.searchsorted(ends, target), len(values) - 1)]))
        return out

    def to_bytes(self) -> bytes:
        parts = [HEAD.pack(self.high, len(self.levels), self.k, self.n, self.coin, self.low, self.top)]
        for c in self.levels:
            parts += [struct.pack("<QHII", c.state, c.k, c.sections, len(c.items)), c.items.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeSketch:
        high, levels, k, n, coin, low, top = HEAD.unpack_from(data)
        sketch = cls(k, bool(high))
        sketch.n, sketch.coin, sketch.low, sketch.top, sketch.levels = n, coin, low, top, []
        at = HEAD.size
        for _ in range(levels):
            c = Compactor(k)
            c.state, c.k, c.sections, size = struct.unpack_from("<QHII", data, at)
            at += 18
            c.items = np.frombuffer(data, dtype=np.float64, count=size, offset=at).copy()
            at += 8 * size
            sketch.levels.append(c)
        return sketch


def runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys in sorted columns."""
    if not keys or not len(keys[0]):
        return
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for column in keys:
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts, [*starts[1:], len(keys[0])])
