"""Pair merges of byte-pair vocabularies, for many short texts side by side."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: rank of a pair that makes nothing
LAST = 1 << 40


class PairTable:
    """Pairs of symbols that merge, with their rank and the symbol they make."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], n_symbols: int):
        rows = np.array(sorted((left * n_symbols + right, rank, made) for left, right, rank, made in pairs), np.int64).reshape(-1, 3)
        self.n = n_symbols
        self.key, self.rank, self.made = (np.ascontiguousarray(c) for c in rows.T)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``LAST`` if they make none) and result; -1 is no symbol."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        good = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], LAST), self.made[at]

    def merged(self, symbol: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, symbols and first places (in ``symbol``) after all merges of
        texts that lie end to end (``of``: each place's text, ascending).  In every
        text the best-ranked pair of neighbours merges first, the leftmost of equal
        ones; a round makes one merge in each text that has any."""
        place = np.arange(len(symbol))
        symbol, rank, made = symbol.astype(np.int64), np.full(len(symbol), LAST), np.zeros(len(symbol), np.int64)
        done = [(of[:0], symbol[:0], place[:0])]

        def look(at):
            """Ranks of the pairs that begin at ``at``."""
            at = at[at + 1 < len(of)]
            at = at[of[at] == of[at + 1]]
            rank[at], made[at] = self.of(symbol[at], symbol[at + 1])

        look(place)
        while len(of):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(of)))
            if (best == LAST).any():
                over = np.repeat(best == LAST, sizes)
                done.append((of[over], symbol[over], place[over]))
                of, symbol, place, rank, made = (x[~over] for x in (of, symbol, place, rank, made))
                if not len(of):
                    break
                best, sizes = best[best != LAST], sizes[best != LAST]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.diff(of[hit], prepend=-1) != 0]  # the leftmost of each text
            symbol[hit] = made[hit]
            kept = np.ones(len(of), bool)
            kept[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after the merged symbols have gone
            of, symbol, place, rank, made = (x[kept] for x in (of, symbol, place, rank, made))
            rank[at] = LAST
            look(at)
            look(at[at > 0] - 1)
        of, symbol, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return of[order], symbol[order], place[order]
