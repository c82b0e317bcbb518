"""The context tree of :mod:`nearline.llm.ctw` as sorted arrays.

A gram is a byte with the ``depth`` bytes before it, packed into one number:
the nearest byte first, the coded byte last.  In sorted grams, all contexts of
every depth, and all nodes of a byte's binary tree below them, are runs, so
counts are run sums and a run's parent is a division away.  ``NodeTable`` holds
what every (context, node) of a shard needs for mixing; a shard has whole
contexts of two bytes, and what lies above them (:class:`Root`) has a fixed size.
"""

from __future__ import annotations

import numpy as np

from .bbit import _LOWER

SHARED = 2                           # contexts of fewer bytes go over all shards


def grams(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of every text and of its end (a byte 0), and the
    offsets of the texts among them; bytes before a text are 0."""
    if not 2 <= depth <= 7:
        raise ValueError("depths from 2 to 7")
    n = len(offs) - 1
    where = offs + np.arange(n + 1)
    x = np.zeros(len(data) + n, np.uint64)
    keep = np.ones(len(x), bool)
    keep[where[1:] - 1] = False                               # the ends
    x[keep] = _LOWER[data]
    key, before = x.copy(), x
    for k in range(depth):
        shifted = np.zeros_like(before)
        shifted[1:] = before[:-1]
        shifted[where[:-1]] = 0
        before = shifted
        key |= before << np.uint64(8 * (depth - k))
    return key, where


_TABLE = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])          # ln of (1/2)(3/2)...(n - 1/2)
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE, dtype=float)))])   # ln n!


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3)


def _rising(n: np.ndarray, table: np.ndarray, start: float, log_first: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1)]
    large = n >= _TABLE
    if large.any():
        out = np.where(large, _stirling(np.maximum(n, 1) + start) - log_first, out)
    return out


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    half = 0.5723649429247001                                 # ln of the gamma function at 1/2
    return _rising(zeros, _HALF, 0.5, half) + _rising(ones, _HALF, 0.5, half) - _rising(zeros + ones, _WHOLE, 1.0, 0.0)


def _share(beta_log: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta_log, -700, 700)))


class _Level:
    """The runs of one depth and bit: (context, first bits of the byte)."""

    def __init__(self, key: np.ndarray, count: np.ndarray, bit: int):
        prefix = key >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        self.prefix, self.first = prefix[first], first
        self.run = np.zeros(len(key), np.int64)               # the run of every gram
        self.run[first[1:]] = 1
        self.run = np.cumsum(self.run)
        one = np.where((key >> np.uint64(7 - bit)) & np.uint64(1), count, 0)
        self.ones = np.add.reduceat(one, first)
        self.zeros = np.add.reduceat(count, first) - self.ones
        self.block = block_log(self.zeros, self.ones)
        self.own = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        self.weighted, self.share = self.block, None


class NodeTable:
    """All contexts of ``SHARED`` bytes or more of sorted, distinct grams."""

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int):
        self.key, self.count, self.depth = key, count, depth
        self.levels: dict[int, list[_Level]] = {}
        self.up = {depth: np.arange(len(key))}                # each deepest gram's gram at a depth
        below, parent = None, None
        for d in range(depth, SHARED - 1, -1):
            if d < depth:
                shorter = (key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255))
                key, parent = np.unique(shorter, return_inverse=True)
                count = np.bincount(parent, weights=count, minlength=len(key)).astype(np.int64)
                self.up[d] = parent[self.up[d + 1]]
            here = [_Level(key, count, bit) for bit in range(8)] if len(key) else []
            for own, child in zip(here, below or []):
                children = np.bincount(own.run[parent[child.first]], weights=child.weighted, minlength=len(own.first))
                own.share = _share(own.block - children)
                own.weighted = np.logaddexp(own.block, children) - np.log(2)
            self.levels[d], below = here, here

    def top(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per byte before: the weighted logs of its two-byte contexts added up
        by node (255), and the counts of the coded bytes (256)."""
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for bit, level in enumerate(self.levels[SHARED]):
            last = (level.prefix >> np.uint64(8 + bit)).astype(np.int64)
            node = (1 << bit) - 1 + (level.prefix & np.uint64((1 << bit) - 1)).astype(np.int64)
            total = np.bincount(last * 255 + node, weights=level.weighted, minlength=256 * 255).reshape(256, 255)
            for b in np.unique(last):
                mine = out.setdefault(int(b), (np.zeros(255), np.zeros(256)))
                mine[0][:] += total[b]
        last, x = (self.key >> np.uint64(8 * self.depth)).astype(np.int64), (self.key & np.uint64(255)).astype(np.int64)
        counts = np.bincount(last * 256 + x, weights=self.count, minlength=65536).reshape(256, 256)
        for b in out:
            out[b][1][:] += counts[b]
        return out

    def logs(self, asked: np.ndarray, root: Root) -> np.ndarray:
        """log10 of the probability of the coded byte of every asked gram."""
        at = np.minimum(np.searchsorted(self.key, asked), max(len(self.key) - 1, 0))
        known = self.key[at] == asked if len(self.key) else np.zeros(len(asked), bool)
        out = np.empty(len(asked))
        place = at[known]
        at_depth = {d: up[place] for d, up in self.up.items()}
        out[known] = self._mixed(asked[known], lambda d, bit: self.levels[d][bit].run[at_depth[d]], root)
        other = asked[~known]
        out[~known] = self._mixed(other, lambda d, bit: self._find(other, d, bit), root)
        return out

    def _find(self, asked: np.ndarray, d: int, bit: int) -> np.ndarray:
        """The run of a gram that need not be there; -1: no such context and node."""
        prefix = self.levels[d][bit].prefix
        context = asked >> np.uint64(8 * (self.depth - d + 1)) << np.uint64(bit)
        want = context | ((asked & np.uint64(255)) >> np.uint64(8 - bit))
        at = np.minimum(np.searchsorted(prefix, want), len(prefix) - 1)
        return np.where(prefix[at] == want, at, -1)

    def _mixed(self, asked: np.ndarray, run, root: Root) -> np.ndarray:
        x = (asked & np.uint64(255)).astype(np.int64)
        last = (asked >> np.uint64(8 * self.depth)).astype(np.int64)
        total = np.zeros(len(asked))
        for bit in range(8):
            one = np.full(len(asked), 0.5)
            for d in range(self.depth, SHARED - 1, -1):
                if not self.levels[d] or not len(asked):
                    continue
                k = run(d, bit)
                level = self.levels[d][bit]
                mine = level.own[k] if level.share is None else level.share[k] * level.own[k] + (1 - level.share[k]) * one
                one = np.where(k >= 0, mine, 0.5)
            node = (1 << bit) - 1 + (x >> (8 - bit))
            one = root.mixed(last, node, one)
            total += np.log10(np.where((x >> (7 - bit)) & 1, one, 1 - one))
        return total


def _bit_counts(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes (heap order, root first) from counts of
    bytes along the last axis."""
    zeros, ones, level = [], [], leaves
    for _ in range(8):
        zeros.append(level[..., 0::2])
        ones.append(level[..., 1::2])
        level = level[..., 0::2] + level[..., 1::2]
    return np.concatenate(zeros[::-1], axis=-1).astype(np.int64), np.concatenate(ones[::-1], axis=-1).astype(np.int64)


class Root:
    """Depths 0 and 1, from the shards' tops: 256 times 255 nodes."""

    def __init__(self, children: np.ndarray, counts: np.ndarray):
        zeros, ones = _bit_counts(counts)
        block = block_log(zeros, ones)
        self.own, self.share = (ones + 0.5) / (zeros + ones + 1), _share(block - children)
        weighted = np.where(zeros + ones > 0, np.logaddexp(block, children) - np.log(2), 0.0).sum(axis=0)
        z, o = zeros.sum(axis=0), ones.sum(axis=0)
        self.own0, self.share0 = (o + 0.5) / (z + o + 1), _share(block_log(z, o) - weighted)
        self.seen, self.seen0 = zeros + ones > 0, z + o > 0

    def mixed(self, last: np.ndarray, node: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        share, own = self.share[last, node], self.own[last, node]
        one = np.where(self.seen[last, node], share * own + (1 - share) * deeper, 0.5)
        return np.where(self.seen0[node], self.share0[node] * self.own0[node] + (1 - self.share0[node]) * one, 0.5)
