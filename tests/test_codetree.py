"""The bounded walk over code tuples against scoring every item."""

import numpy as np
import pytest

from lumenrec.operators.codetree import CodeTree, log_softmax, prefix_bounds


def tree_of(codes, ids):
    order = np.lexsort((ids, *codes.T[::-1]))
    codes, ids = codes[order], ids[order]
    new = np.append(True, (codes[1:] != codes[:-1]).any(axis=1))
    return CodeTree(codes[new], np.append(np.flatnonzero(new), len(ids)), ids)


def plain_best(z, codes, ids, k):
    out = []
    for u in range(len(z)):
        score = sum(z[u, level, codes[:, level]] for level in range(codes.shape[1]))
        for i in np.lexsort((ids, -score))[:k]:
            out.append((u, ids[i], score[i]))
    return out


@pytest.mark.parametrize("size,levels,items,k", [(4, 3, 300, 10), (16, 4, 2000, 10), (3, 1, 2, 5), (64, 3, 5000, 1), (2, 5, 700, 40)])
def test_walk_finds_the_best_items(size, levels, items, k):
    r = np.random.default_rng(size + k)
    codes, ids = r.integers(0, size, (items, levels)), r.permutation(items * 2)[:items]
    for spread in (0.0, 0.3, 4.0):
        z = log_softmax(np.round(r.normal(size=(9, levels, size)) * spread, 1))  # rounded: scores tie
        tree = tree_of(codes, ids)
        u, item, score = tree.best(z, k)
        assert list(zip(u, item, score)) == plain_best(z, codes, ids, k)


@pytest.mark.parametrize("lean,k,share", [(0.0, 10, 0.25), (12.0, 1, 0.05)])
def test_bounds_close_most_of_the_tree(lean, k, share):
    """Without any likely item, and with scores that lean to one item a user."""
    r = np.random.default_rng(1)
    codes, ids = r.integers(0, 64, (100_000, 4)), np.arange(100_000)
    tree = tree_of(codes, ids)
    z = r.normal(size=(20, 4, 64)) * 3
    for u in range(20):
        z[u, np.arange(4), codes[u]] += lean
    z = log_softmax(z)
    u, item, score = tree.best(z, k)
    assert list(zip(u, item, score)) == plain_best(z, codes, ids, k)
    nodes = sum(map(len, tree.codes))
    assert tree.opened < 20 * nodes * share


def test_prefix_bounds_hold():
    r = np.random.default_rng(2)
    codes = r.integers(0, 8, (500, 3))
    z = log_softmax(r.normal(size=(7, 3, 8)))
    score = sum(z[:, level, codes[:, level]] for level in range(3))
    for depth in (0, 1, 2, 3):
        prefixes = np.unique(codes[:, :depth], axis=0) if depth else np.zeros((1, 0), dtype=int)
        bound = prefix_bounds(z, prefixes)
        for p, at in enumerate(prefixes):
            assert (score[:, (codes[:, :depth] == at).all(axis=1)] <= bound[:, [p]]).all()
