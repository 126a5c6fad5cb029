"""Ranked pair merges of many short words at once, in array rounds.

Each round finds every word's merge of lowest rank (the leftmost of equal
ones) and applies it, so a word's merges come in the same order as one by
one. Words without a merge left are done and leave the arrays.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1 << 30)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairMerges:
    """The merge list as an open hash table over pairs of ids."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int], size: int) -> None:
        self.size = size
        self.merged = np.array(merged, np.int64)
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.zeros(1 << bits, np.int64)
        rank = np.arange(len(pairs))
        key = np.array([a * size + b for a, b in pairs], np.int64)
        slot, self.probes = self._slot(key), 0
        while len(key):
            # The first of those that meet in a free slot takes it, the others move on.
            taken = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[taken], return_index=True)
            taken = taken[first]
            self.keys[slot[taken]], self.ranks[slot[taken]] = key[taken], rank[taken]
            left = np.ones(len(key), bool)
            left[taken] = False
            key, rank, slot = key[left], rank[left], slot[left] + 1 & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; a number above all ranks where there is none."""
        key = left * self.size + right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        slot = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            slot = slot + 1 & self.mask
            there = self.keys[slot]
            same = there == key[open_]
            out[open_[same]] = self.ranks[slot[same]]
            more = ~same & (there >= 0)
            open_, slot = open_[more], slot[more]
        return out

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``lengths`` symbols, one after the other in ``ids``, fully
        merged: their tokens in the same order, and each word's number."""
        ids = ids.astype(np.int64)
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            live = best >> 32 < _NONE
            stays = np.repeat(live, np.diff(starts, append=len(ids)))
            if not live.all():
                done_ids.append(ids[~stays])
                done_words.append(word[~stays])
            best = best[live]
            at = best & 0xFFFFFFFF
            ids[at] = self.merged[best >> 32]
            stays[at + 1] = False
            at = np.cumsum(stays)[at] - 1
            # The merged pair's right half takes its rank of the next pair along.
            ids, word, rank = ids[stays], word[stays], rank[stays]
            for low in (at[at > 0] - 1, at):
                low = low[low + 1 < len(ids)]
                same = word[low] == word[low + 1]
                pair = low[same]
                rank[low[~same]] = _NONE
                rank[pair] = self.rank(ids[pair], ids[pair + 1])
            if len(at) and at[-1] == len(ids) - 1:
                rank[-1] = _NONE
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
        words = np.concatenate(done_words)
        return np.concatenate(done_ids)[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lengths))


def packed(ids: np.ndarray, counts: np.ndarray, kind: np.dtype) -> list[bytes]:
    """Each word's tokens as bytes of ``kind``."""
    raw = ids.astype(kind).tobytes()
    at = (np.concatenate([[0], np.cumsum(counts)]) * kind.itemsize).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
