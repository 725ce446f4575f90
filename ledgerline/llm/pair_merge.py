"""Byte-pair merges of many short symbol sequences at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Longer sequences are better left to a library: the cost of one is the square of its length.
MAX_SYMBOLS = 48
#: Sequences that are merged side by side.
_ROWS = 16_384


class PairMerger:
    """Merges neighbours by rank, lowest first and leftmost of equals, until no pair of a sequence is in the table.

    `left`, `right`, `rank` and `made` list the pairs and the symbols that their merges leave.
    """

    def __init__(self, left: Sequence[int], right: Sequence[int], rank: Sequence[int], made: Sequence[int]) -> None:
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        ranks = np.array(rank, dtype=np.int32)
        # Most ranks leave one symbol; for the others the pair tells.
        self.made = np.full(int(ranks.max(initial=0)) + 1, -1, dtype=np.int32)
        self.made[ranks] = made
        shared = np.zeros(len(self.made), dtype=bool)
        shared[ranks[self.made[ranks] != np.array(made, dtype=np.int32)]] = True
        self.made[shared] = -1
        self.by_pair = {k: m for k, r, m in zip(keys.tolist(), ranks.tolist(), made) if shared[r]}
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.ranks = np.full(1 << self.bits, _NONE)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            # Of the keys that want one free slot the first gets it, the others move on.
            free = todo[self.keys[at[todo]] == _EMPTY]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a negative symbol has none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], _NONE)
        todo = np.flatnonzero((held != keys) & (held != _EMPTY) & (left >= 0) & (right >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held, want = self.keys[at], keys[todo]
            same = held == want
            out[todo[same]] = self.ranks[at[same]]
            more = ~same & (held != _EMPTY)
            todo, at = todo[more], at[more]
        return np.where((left >= 0) & (right >= 0), out, _NONE)

    def _merge(self, rows: np.ndarray) -> np.ndarray:
        """The rows of a matrix after all merges: symbols stay at the place of their first part, -1 is at all other places."""
        n, width = rows.shape
        if width < 2 or not n:
            return rows
        # Flat places, each symbol linked to its neighbours; a place of the last column more takes what has no neighbour.
        none = n * width
        flat = np.append(rows.ravel(), np.int32(-1))
        after = np.arange(1, none + 2)
        after[width - 1 :: width] = none
        before = np.arange(-1, none)
        before[::width] = none
        after[none] = before[none] = none
        ranks = np.append(self._rank(flat, flat[after]), _NONE)
        live = np.arange(n)
        while len(live):
            block = ranks[: n * width].reshape(n, width)[live] if len(live) < n else ranks[: n * width].reshape(n, width)
            best = block.argmin(axis=1)
            least = block[np.arange(len(live)), best]
            more = least != _NONE
            if not more.all():
                live, best, least = live[more], best[more], least[more]
            at = live * width + best
            gone = after[at]
            then, past = after[gone], before[at]
            made = self.made[least]
            for i in np.flatnonzero(made < 0).tolist():
                made[i] = self.by_pair[int(flat[at[i]]) << 32 | int(flat[gone[i]])]
            flat[at], flat[gone], ranks[gone] = made, -1, _NONE
            after[at], before[then] = then, at
            before[none] = none
            ranks[at], ranks[past] = self._rank(made, flat[then]), self._rank(flat[past], made)
            ranks[none] = _NONE
        return flat[:none].reshape(n, width)

    def __call__(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) after all merges of sequences that stand one after the other; a sequence may be long, but costs the square of its length."""
        ends = np.cumsum(sizes)
        out, counts = np.full(len(symbols), -1, dtype=np.int32), np.zeros(len(sizes), dtype=np.int64)
        widths = (sizes + 3) // 4 * 4
        for width in np.unique(widths).tolist():
            whole = np.flatnonzero(widths == width)
            for low in range(0, len(whole), _ROWS):
                group = whole[low : low + _ROWS]
                at = (ends - sizes)[group, None] + np.arange(width)
                here = np.arange(width) < sizes[group, None]
                merged = self._merge(np.where(here, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32))
                out[at[here]] = merged[here]
                counts[group] = (merged >= 0).sum(axis=1)
        return out[out >= 0], counts
