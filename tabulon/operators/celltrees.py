"""Classification trees over cells: rows between the same candidate cuts, counted by class.

A tree sees of a row only between which cuts its values lie, so the rows of a cell and class are one
weighted row.  A bootstrap draws every row Poisson(1) times on its own, as Spark ML's forests do: that
is Poisson(n) draws of a cell's n rows.  A tree is grown level by level in one process from the
histograms of its open nodes, under the rules of Spark ML: Gini gain, the first of equal cuts, features
drawn per node, leaves of one class or without gain, sibling leaves that predict alike merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

NODES = 256          # whose cuts are compared at a time
LEAST = 1e-12        # impurity or gain that counts as none


@dataclass
class Tree:
    """Nodes by number, the root first, children after their parents; left -1: a leaf.

    A split on ``feature`` sends places up to ``cut`` to the left."""
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    stats: np.ndarray     # draws by class
    gain: np.ndarray
    impurity: np.ndarray


def _best_cuts(hist: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node its best cut of one feature and the Gini gain there, from hist[node, place, class]."""
    cut, gain = np.zeros(len(hist), np.int64), np.zeros(len(hist))
    for a in range(0, len(hist), NODES):
        here = slice(a, a + NODES)
        low = hist[here].cumsum(axis=1)[:, :-1]
        high = stats[here, None] - low
        n_low, n_high = low.sum(axis=2), high.sum(axis=2)
        total = stats[here].sum(axis=1)
        score = (low * low).sum(axis=2) / np.maximum(n_low, 1) + (high * high).sum(axis=2) / np.maximum(n_high, 1)
        score[(n_low < 1) | (n_high < 1)] = -np.inf
        cut[here] = score.argmax(axis=1)
        gain[here] = (score.max(axis=1) - (stats[here] ** 2).sum(axis=1) / total) / total
    return cut, gain


def grow(places: np.ndarray, label: np.ndarray, weight: np.ndarray, sizes: Sequence[int], n_classes: int,
         max_depth: int, per_node: int, rng: np.random.Generator) -> Tree:
    """One tree over weighted rows: places[feature, row] (of ``sizes``), class and draws of every row."""
    drawn = weight > 0
    places, label, weight = places[:, drawn], label[drawn].astype(np.int64), weight[drawn].astype(np.float64)
    node = np.zeros(len(label), np.int64)             # of a row, within the level
    stats = np.bincount(label, weight, n_classes)[None]
    levels, first = [], 0
    for depth in range(max_depth + 1):
        total = stats.sum(axis=1)
        impurity = 1 - (stats ** 2).sum(axis=1) / np.maximum(total, 1) ** 2
        gain, feature, cut = np.zeros(len(stats)), np.full(len(stats), -1), np.zeros(len(stats), np.int64)
        is_open = (impurity > LEAST) & (depth < max_depth)
        asked = rng.random((len(stats), len(sizes))).argsort(axis=1).argsort(axis=1) < per_node
        for f in range(len(sizes)):
            mine = is_open & asked[:, f]
            if sizes[f] < 2 or not mine.any():
                continue
            nodes, number = np.flatnonzero(mine), np.cumsum(mine) - 1
            rows = np.flatnonzero(mine[node])
            key = (number[node[rows]] * sizes[f] + places[f, rows]) * n_classes + label[rows]
            hist = np.bincount(key, weight[rows], len(nodes) * sizes[f] * n_classes)
            c, g = _best_cuts(hist.reshape(len(nodes), sizes[f], n_classes), stats[nodes])
            better = g > np.maximum(gain[nodes], LEAST)
            gain[nodes[better]], feature[nodes[better]], cut[nodes[better]] = g[better], f, c[better]
        split = feature >= 0
        child = first + len(stats) + 2 * (np.cumsum(split) - 1)
        levels.append((np.where(split, child, -1), np.where(split, child + 1, -1), feature, cut, stats,
                       np.where(split, gain, -1.0), impurity))
        if not split.any():
            break
        rows = np.flatnonzero(split[node])
        places, label, weight, node = places[:, rows], label[rows], weight[rows], node[rows]
        goes_right = places[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + goes_right
        first += len(stats)
        n = 2 * int(split.sum())
        stats = np.bincount(node * n_classes + label, weight, n * n_classes).reshape(n, n_classes)
    return _merged(Tree(*(np.concatenate(c) for c in zip(*levels, strict=True))), [len(lv[0]) for lv in levels])


def _merged(tree: Tree, sizes: Sequence[int]) -> Tree:
    """The tree with sibling leaves of one prediction merged into their parent, from the deepest level up."""
    says = tree.stats.argmax(axis=1)
    leaf = tree.left < 0
    ends = np.cumsum(sizes)
    kept = np.ones(len(leaf), bool)
    for end, size in zip(ends[::-1], reversed(sizes), strict=True):
        at = np.arange(end - size, end)
        at = at[~leaf[at]]
        left, right = tree.left[at], tree.right[at]
        one = leaf[left] & leaf[right] & (says[left] == says[right])
        leaf[at[one]] = True
        kept[left[one]] = kept[right[one]] = False
    number = np.cumsum(kept) - 1
    inner = ~leaf[kept]

    def renumbered(child):
        return np.where(inner, number[child[kept]], -1)

    return Tree(renumbered(tree.left), renumbered(tree.right), np.where(inner, tree.feature[kept], -1), tree.cut[kept],
                tree.stats[kept], np.where(inner, tree.gain[kept], -1.0), tree.impurity[kept])
