"""Exact best items by sums of code scores: a prefix tree of the distinct code tuples, walked with upper bounds.

A node's score is the sum over its levels, its bound the same with each further level's largest score added in order.
Rounding is monotone, so no item below a node scores above its bound. A first walk follows the best nodes of each
level to k items at least, whose k-th score is a threshold; a second opens only nodes whose bound reaches it.
"""

from __future__ import annotations

import numpy as np

#: Nodes that a walk may hold at a time if no bound closes any.
OPEN_NODES = 1 << 22


def log_softmax(logits: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    z = logits - logits.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def first_of_groups(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group; groups are runs in ascending order."""
    return np.arange(len(group)) - np.searchsorted(group, group) < k


class CodeTree:
    """Distinct code tuples [tuple, level] in lexicographic order, with the items of each: tuple i has ids[starts[i]:starts[i + 1]], ascending."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        n, self.levels = codes.shape
        new = np.ones((n, self.levels), dtype=bool)
        new[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        at = [np.flatnonzero(new[:, level]) for level in range(self.levels)]
        self.codes = [codes[rows, level] for level, rows in enumerate(at)]
        place = np.cumsum(new, axis=0) - 1
        # children of a node: from its first to the next node's first
        self.first = [np.append(place[at[level], level + 1], len(at[level + 1])) for level in range(self.levels - 1)]
        self.starts, self.ids, self.opened = starts, ids, 0

    def _below(self, level: int, z: np.ndarray, u: np.ndarray, node: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """User, node, score of the nodes at a level under those given, at level 0 of all users."""
        if level == 0:
            n = len(self.codes[0])
            u, node, score = np.repeat(np.arange(len(z)), n), np.tile(np.arange(n), len(z)), np.zeros(len(z) * n)
        else:
            first = self.first[level - 1]
            many = first[node + 1] - first[node]
            u, score = np.repeat(u, many), np.repeat(score, many)
            node = np.arange(many.sum()) + np.repeat(first[node] - (np.cumsum(many) - many), many)
        self.opened += len(u)
        return u, node, score + z[u, level, self.codes[level][node]]

    def _threshold(self, z: np.ndarray, k: int) -> np.ndarray:
        """A score that k items of each user reach, by the best k nodes of each level."""
        none = np.zeros(0, dtype=np.int64)
        u, node, score = none, none, np.zeros(0)
        for level in range(self.levels):
            u, node, score = self._below(level, z, u, node, score)
            order = np.lexsort((-score, u))
            order = order[first_of_groups(u[order], k)]
            u, node, score = u[order], node[order], score[order]
        many = np.cumsum(self.starts[node + 1] - self.starts[node])
        before = np.append(0, many)[np.searchsorted(u, u)]
        found = np.full(len(z), -np.inf)
        reach = np.flatnonzero(many - before >= k)[::-1]
        found[u[reach]] = score[reach]  # the first that reaches k is written last
        return found

    def best(self, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """User, item, score of the k best items of each user, in order, for scores z [user, level, code]; equal scores go by item."""
        step = max(1, OPEN_NODES // max(1, len(self.starts)))
        parts = [self._best(z[i : i + step], k) for i in range(0, len(z), step)]
        return tuple(np.concatenate([p[0] + i * step if c == 0 else p[c] for i, p in enumerate(parts)]) for c in range(3))

    def _best(self, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = self._threshold(z, k)
        top = np.stack([z[:, level, np.unique(c)].max(axis=1) for level, c in enumerate(self.codes)], axis=1)
        none = np.zeros(0, dtype=np.int64)
        u, node, score = none, none, np.zeros(0)
        for level in range(self.levels):
            u, node, score = self._below(level, z, u, node, score)
            bound = score
            for more in range(level + 1, self.levels):
                bound = bound + top[u, more]
            stays = bound >= least[u]
            u, node, score = u[stays], node[stays], score[stays]
        many = self.starts[node + 1] - self.starts[node]
        item = self.ids[np.arange(many.sum()) + np.repeat(self.starts[node] - (np.cumsum(many) - many), many)]
        u, score = np.repeat(u, many), np.repeat(score, many)
        order = np.lexsort((item, -score, u))
        order = order[first_of_groups(u[order], k)]
        return u[order], item[order], score[order]


def prefix_bounds(z: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """[user, prefix]: no tuple that begins with a prefix scores above it."""
    bound = np.zeros((len(z), len(prefixes)))
    for level in range(z.shape[1]):
        bound = bound + (z[:, level, prefixes[:, level]] if level < prefixes.shape[1] else z[:, level].max(axis=1, keepdims=True))
    return bound
