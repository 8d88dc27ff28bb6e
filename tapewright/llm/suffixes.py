"""Suffix arrays of a shard's regions in numpy: Larsson-Sadakane refinement, Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Symbols in a first key, of 9 bits each: a byte plus one, or 0 for a region's end.
SYMBOLS = 7
#: Positions of a region that are scanned one after the other.
LANE = 256


class Shard:
    """Regions laid end to end, each followed by its own end mark; an earlier region's mark is the lesser."""

    def __init__(self, regions: list[bytes]):
        self.sizes = np.array([len(r) for r in regions], np.int64)
        self.bases = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.n = int((self.sizes + 1).sum())
        text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
        self.region = np.repeat(np.arange(len(regions), dtype=np.int32), self.sizes + 1)
        #: Position of the end mark of a position's region.
        self.mark = (self.bases + self.sizes)[self.region]
        symbols = text.astype(np.int64) + 1
        symbols[self.bases + self.sizes] = 0
        self.keys = symbols.copy()
        place = np.arange(self.n)
        for k in range(1, SYMBOLS):
            there = np.minimum(place + k, self.n - 1)
            self.keys = (self.keys << 9) | np.where(place + k <= self.mark, symbols[there], 0)

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their suffixes, and each position's rank.

        Suffixes are grouped by their first symbols; only groups that are not single are sorted again, by the ranks a depth
        further on, and the depth doubles.
        """
        order = np.argsort(self.keys)
        # End marks, whose keys are all 0, come first and in their own order.
        order[: len(self.sizes)] = self.bases + self.sizes
        slots = np.arange(self.n)
        new = np.ones(self.n, bool)
        new[1:] = self.keys[order[1:]] != self.keys[order[:-1]]
        # End marks have positions of their own from the start.
        new[: len(self.sizes) + 1] = True
        rank = np.empty(self.n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        open_slots = slots[_in_groups(new)]
        depth = SYMBOLS
        while len(open_slots):
            at = order[open_slots]
            ahead = at + depth
            # A suffix that ended within the depth equals only suffixes that ended too; the earlier region comes first.
            second = np.where(ahead <= self.mark[at], rank[np.minimum(ahead, self.n - 1)] + self.n, at)
            joint = (rank[at] << 32) + second
            by = np.argsort(joint)
            order[open_slots] = at[by]
            joint = joint[by]
            new = np.ones(len(at), bool)
            new[1:] = joint[1:] != joint[:-1]
            rank[at[by]] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            open_slots = open_slots[_in_groups(new)]
            depth *= 2
        return order, rank

    def common_prefixes(self, order: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
        """By position, the length its suffix has in common with its predecessor in the order, at most `cap`.

        In text order a length falls by one at most from one position to the next. Stretches of LANE positions advance side by
        side: in each turn a stretch compares one key, and either goes on behind it or ends its position and moves to the next.
        """
        lengths = np.zeros(self.n, np.int64)
        at = np.concatenate([np.arange(b, b + n, LANE) for b, n in zip(self.bases.tolist(), self.sizes.tolist())] or [np.arange(0)])
        end = np.minimum(at + LANE, self.mark[at])
        known = np.zeros(len(at), np.int64)
        before = order[rank[at] - 1]
        limit = np.minimum(np.minimum(self.mark[at] - at, self.mark[before] - before), cap)
        while len(at):
            alike = _alike(self.keys[at + known], self.keys[before + known])
            known = np.minimum(known + alike, limit)
            ended = (alike < SYMBOLS) | (known == limit)
            lengths[at[ended]] = known[ended]
            at = at + ended
            live = at < end
            if not live.all():
                at, end, before, known, limit, ended = (x[live] for x in (at, end, before, known, limit, ended))
            moved = np.flatnonzero(ended)
            place = at[moved]
            prior = order[rank[place] - 1]
            before[moved] = prior
            limit[moved] = np.minimum(np.minimum(self.mark[place] - place, self.mark[prior] - prior), cap)
            known[moved] = np.maximum(known[moved] - 1, 0)
        return lengths


def _alike(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Number of leading symbols that two keys share."""
    apart = here ^ there
    # The highest set bit; with the bit below it cleared, a float cannot round up to the next power of two.
    bit = np.frexp((apart & ~(apart >> 1)).astype(np.float64))[1]
    return np.where(apart == 0, SYMBOLS, (9 * SYMBOLS - bit) // 9)


def _in_groups(new: np.ndarray) -> np.ndarray:
    """Which sorted entries are not alone in their group."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ~alone


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of several sorted runs of distinct values, and their summed counts, merged two by two by binary search."""
    while len(runs) > 1:
        runs = [_merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _merged(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    (a, n), (b, m) = left, right
    at = np.searchsorted(a, b)
    shared = np.zeros(len(b), bool)
    inside = at < len(a)
    shared[inside] = a[at[inside]] == b[inside]
    counts = n.copy()
    counts[at[shared]] += m[shared]
    return np.insert(a, at[~shared], b[~shared]), np.insert(counts, at[~shared], m[~shared])
