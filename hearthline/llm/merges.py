"""Vectorised merge rounds over many words at once, shared by the encoders."""

from __future__ import annotations

import numpy as np

NONE = np.int64(2**62)


class Merges:
    """Which pairs of symbols merge, in what order of rank, into what."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], n_symbols: int) -> None:
        self.width = np.int64(n_symbols + 1)
        flat = {a * int(self.width) + b: x for (a, b), x in pairs.items()}
        self.keys = np.array(sorted(flat), dtype=np.int64)
        self.ranks = np.array([flat[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([flat[k][1] for k in self.keys.tolist()], dtype=np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def run(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, symbol, place of its first symbol in the input), in order, when no pair is left.

        sym: symbols of all words one after another, below 0 where a symbol never merges; word: their words, rising.
        Each round merges the leftmost of the best-ranked pairs of every word; words without a pair leave the arrays.
        """
        place, rank, into = np.arange(len(sym)), np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        done = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            idle = np.repeat(best == NONE, lengths)
            if idle.any():
                done.append((word[idle], sym[idle], place[idle]))
                sym, place, word, rank, into = (x[~idle] for x in (sym, place, word, rank, into))
                if not len(sym):
                    break
                lengths, best = lengths[best != NONE], best[best != NONE]
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            at = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            sym[at] = into[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))  # one symbol has gone from each word before
            sym, place, word, rank, into = (x[keep] for x in (sym, place, word, rank, into))
            for p in (new_at - 1, new_at):
                p = p[(p >= 0) & (p + 1 < len(sym))]
                r, m = self.lookup(sym[p], sym[p + 1])
                rank[p], into[p] = np.where(word[p] == word[p + 1], r, NONE), m
            if new_at[-1] == len(sym) - 1:
                rank[-1] = NONE
        if not done:
            return word, sym, place
        word, sym, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return word[order], sym[order], place[order]
