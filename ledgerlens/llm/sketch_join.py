"""Similar sets of one block by bottom-k sketches (numpy; one task).

Tokens are values of one hash function, so the k smallest of a set are its
sketch, and what two sketches hold up to the smaller of their largest values
is a sketch of the union (of k to 2k tokens).  The share of it that both hold
estimates the similarity; where both sketches are whole sets, it is the
similarity.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from ledgerlens.llm.packed import ragged
from ledgerlens.llm.set_classes import ASK, INSERT

SKETCH = 64
MISS = 1e-10  # probability that a similar pair shares fewer tokens of a sketch of known size
MISS_ANY = MISS / (SKETCH + 1)  # of one of the sizes that the union's sketch may have
CLOSEST = 8
COMMON = 32  # values of more than one in ``COMMON`` sets are columns of bits


@cache
def least_shared(under: int, over: int, size: int = SKETCH, miss: float = MISS) -> int:
    """Tokens of a union's sketch of ``size`` that a similar pair shares: fewer
    have a probability below ``miss`` (binomial tail; 28 of 64 at 0.8)."""
    p, tail = under / over, 0.0
    for shared in range(size + 1):
        tail += math.comb(size, shared) * p**shared * (1 - p) ** (size - shared)
        if tail > miss:
            return shared
    return size


def least_overlap(n: int, under: int, over: int) -> int:
    """Sketch values that a set of ``n`` tokens shares with any similar set."""
    return min(-(-n * under // over), least_shared(under, over))


@cache
def _least_of_union(under: int, over: int) -> np.ndarray:
    """By size of the union's sketch."""
    return np.array([least_shared(under, over, size, MISS_ANY) for size in range(2 * SKETCH + 1)])


def similar(overlap: np.ndarray, size: int, sizes: np.ndarray, under: int, over: int) -> np.ndarray:
    """Exact, from the overlaps of the full sets."""
    return over * overlap >= under * (size + sizes - overlap)


class Overlaps:
    """Inverted lists of the values that several sets of a block hold.  The
    list of a value of many sets is a column of bits, so that a group of near
    copies costs a few words for each pair and not each shared value."""

    def __init__(self, sets: list[np.ndarray]):
        n = self.n = len(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = (counts > 1) & (counts * COMMON > n)
        column, words = np.cumsum(common) - 1, -(-int(common.sum()) // 64)
        self.bits = np.zeros((words, n), np.uint64)
        mine = common[value]
        at = column[value[mine]]
        np.bitwise_or.at(self.bits.reshape(-1), (at >> 6) * n + owner[mine], np.uint64(1) << (at & 63).astype(np.uint64))
        mine = ~mine & (counts > 1)[value]  # values of one set need no list
        owner, value = owner[mine], value[mine]
        self.members = owner[np.argsort(value, kind="stable")]
        ends = np.cumsum(np.bincount(value, minlength=len(counts)))
        self.lengths = np.bincount(value, minlength=len(counts))[value]
        self.starts = ends[value] - self.lengths
        self.at = np.searchsorted(owner, np.arange(n + 1))

    def of(self, own: int, others: np.ndarray) -> np.ndarray:
        """The number of values that ``own`` shares with each of ``others``."""
        shared = np.bitwise_count(np.take(self.bits, others, axis=1) & self.bits[:, own, None]).sum(axis=0, dtype=np.int64)
        mine = slice(self.at[own], self.at[own + 1])
        met = ragged(self.members, self.starts[mine], self.lengths[mine])
        return shared + np.bincount(met, minlength=self.n)[others] if len(met) else shared


class SketchIndex:
    """The sets of a block, those that are found by others first and by size.
    Every set asks among the earlier ones of other classes."""

    def __init__(self, sets: list[np.ndarray], listed: int, under: int, over: int):
        """Only the first ``listed`` sets are found by others."""
        self.listed, self.under, self.over = listed, under, over
        self.sizes = np.array([len(s) for s in sets])
        self.least = np.array([least_overlap(n, under, over) for n in self.sizes.tolist()])
        self.labels = np.arange(len(sets))
        # Whole sets have no limit: every value of the other sketch is known to be in or out.
        self.sketches = np.full((len(sets), SKETCH), np.iinfo(np.uint64).max, np.uint64)
        for i, s in enumerate(sets):
            self.sketches[i, : len(s[:SKETCH])] = s[:SKETCH]
        self.whole = self.sizes <= SKETCH
        self.shared, self.overlaps = Overlaps([s[:SKETCH] for s in sets]), Overlaps(sets)

    def join(self, members: np.ndarray) -> None:
        """One class of the classes of ``members``."""
        met = np.unique(self.labels[members])
        if len(met) > 1:
            self.labels[np.isin(self.labels, met)] = met[0]

    def _held(self, at: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Sketch values of the sets ``at`` up to their limits (binary search)."""
        held = np.zeros(len(at), np.int64)
        for step in (32, 16, 8, 4, 2, 1, 1):
            held += step * (self.sketches[at, held + step - 1] <= limits)
        return np.minimum(held, self.sizes[at])

    def may_link(self, own: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The estimate from the union's sketch leaves the threshold in reach;
        ``shared`` are the overlaps of the sketches."""
        none = np.iinfo(np.uint64).max
        limits = np.minimum(
            np.where(self.whole[others], none, self.sketches[others, -1]), none if self.whole[own] else self.sketches[own, -1])
        union = self._held(others, limits) + self._held(np.full(len(others), own), limits) - shared
        exact = self.whole[others] & self.whole[own]
        return np.where(exact, self.over * shared >= self.under * union, shared >= _least_of_union(self.under, self.over)[union])

    def link(self, own: int) -> None:
        """Join the class of ``own`` with those of all similar earlier sets,
        the closest in size first: in a group of near copies one of them is
        similar, and the whole class is then passed over."""
        size, near = self.sizes[own], self.sizes[: min(own, self.listed)]
        low = np.searchsorted(near, -(-size * self.under // self.over), "left")
        high = np.searchsorted(near, size * self.over // self.under, "right")
        for start in (max(low, high - CLOSEST), low):
            others = start + np.flatnonzero(self.labels[start:high] != self.labels[own])
            if len(others):
                self._ask(own, others)

    def _ask(self, own: int, others: np.ndarray) -> None:
        size, shared = self.sizes[own], self.shared.of(own, others)
        fits = shared >= np.maximum(self.least[others], self.least[own])
        others, shared = others[fits], shared[fits]
        others = others[self.may_link(own, others, shared)]
        overlap = self.overlaps.of(own, others)
        self.join(np.append(others[similar(overlap, size, self.sizes[others], self.under, self.over)], own))


def sketch_links(members: list[tuple[int, int, int, np.ndarray]], under: int, over: int) -> list[tuple[int, int]]:
    """The classes of similar sets of one block as links (number, smallest
    number of its class).  A member is (number, class so far, role, tokens)."""
    members = sorted(members, key=lambda m: (m[2] == ASK, len(m[3]), m[0]))
    index = SketchIndex([m[3] for m in members], sum(m[2] != ASK for m in members), under, over)
    first: dict[int, int] = {}
    for own, (_, label, _, _) in enumerate(members):
        if label in first:
            index.join(np.array([first[label], own]))
        first.setdefault(label, own)
    for own, (_, _, role, _) in enumerate(members):
        if role != INSERT:
            index.link(own)
    return class_stars(index.labels.tolist(), [m[0] for m in members])


def class_stars(roots: list[int], numbers: list[int]) -> list[tuple[int, int]]:
    least: dict[int, int] = {}
    for root, number in zip(roots, numbers, strict=True):
        least[root] = min(number, least.get(root, number))
    return [(number, least[root]) for root, number in zip(roots, numbers, strict=True) if number != least[root]]


