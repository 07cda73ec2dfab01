"""Small in-task fits: one series' training rows up to one origin -> one additive model.

A model is ``intercept + weights . x + sum of one leaf per tree``. Trees are flat arrays over all nodes of
a model: ``feature`` (-1: leaf), ``threshold``, ``left`` (the right child is the next node), ``value`` and the
``roots``. Rows are bounded by the calendar of one series; Spark deals series and origins to tasks.
"""

from __future__ import annotations

import numpy as np


def impute(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing cells become the column's median over these rows, 0 where a column has no value at all; and the medians."""
    missing = np.isnan(x)
    medians = np.zeros(x.shape[1])
    some = ~missing.all(axis=0)
    medians[some] = np.nanmedian(x[:, some], axis=0)
    return np.where(missing, medians, x), medians


def linear(x: np.ndarray, y: np.ndarray, alpha: float = 0.0) -> dict:
    """Least squares on standardised columns (population deviation), ``alpha`` on the squared weights.

    Without ``alpha`` the solution of smallest norm, so collinear columns and fewer rows than columns are defined
    (directions below 1e-10 of the largest singular value are rounding noise of collinear columns and carry no weight).
    A column without spread has deviation 1. The importances are the absolute weights of the standardised columns.
    """
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation[deviation <= 1e-12 * np.abs(mean)] = 1.0
    z, centre = (x - mean) / deviation, y.mean()
    if alpha:
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - centre))
    else:
        beta = np.linalg.lstsq(z, y - centre, rcond=1e-10)[0]
    return {"intercept": float(centre - (beta / deviation) @ mean), "weights": beta / deviation, "importance": np.abs(beta),
            "means": mean, "deviations": deviation}


class Trees:
    """Growing flat arrays of nodes; ``group`` says which model a node belongs to."""

    def __init__(self) -> None:
        self.n, self.blocks, self.roots = 0, [], []

    def own(self, group: int) -> dict:
        """The nodes of one model, renumbered; children stay side by side."""
        feature, threshold, left, value, of = (np.concatenate(c) for c in zip(*self.blocks))
        mine = of == group
        number = np.cumsum(mine) - 1
        roots = np.concatenate([r[of[r] == group] for r in self.roots])
        return {"roots": number[roots], "feature": feature[mine], "threshold": threshold[mine],
                "left": np.where(left[mine] < 0, -1, number[np.maximum(left[mine], 0)]), "value": value[mine]}


def sorted_rows(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """For each column the rows in order of (tree, value)."""
    order = np.argsort(x, axis=0, kind="stable").T
    return np.take_along_axis(order, np.argsort(tree[order], axis=1, kind="stable"), 1)


def grow(trees: Trees, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray, tree: np.ndarray, group: np.ndarray,
         depth: int, penalty: float, rate: float, gains: np.ndarray) -> np.ndarray:
    """Grow one tree for each value of ``tree`` (0, 1, ... along the rows), all of them level by level; returns each row's leaf value.

    A split is the exact best of all columns and borders between different values: the largest fall of the weighted
    squared error, ``penalty`` added to each side's weight (gains equal to 1e-9 of the node's squares: the lowest place
    in the node's order, then the first column). ``order`` lists the rows that count (:func:`sorted_rows`); others only get a value. ``group`` names each
    tree's model; ``gains[model, column]`` sums what its splits gained. Leaves are (penalised) means times ``rate``.
    """
    n_trees, width = int(tree[-1]) + 1, x.shape[1]
    feature, threshold = [np.full(n_trees, -1)], [np.zeros(n_trees)]
    left, of, size = [np.full(n_trees, -1)], [np.asarray(group)], n_trees
    node, at = tree.copy(), order  # every row's node; the rows of nodes that may split, by node and value
    pull, squares = weight * y, weight * y * y
    columns = np.arange(width)[:, None]
    for _ in range(depth):
        if at.shape[1] < 2:
            break
        here = node[at[0]]
        new = np.append(True, here[1:] != here[:-1])
        starts, segment = np.flatnonzero(new), np.cumsum(new) - 1
        w, p = np.cumsum(weight[at], axis=1), np.cumsum(pull[at], axis=1)
        ends = np.append(starts[1:], len(here)) - 1
        before_w, before_p = np.append(0.0, w[0, ends[:-1]]), np.append(0.0, p[0, ends[:-1]])
        all_w, all_p = w[0, ends] - before_w, p[0, ends] - before_p
        # totals of a segment are sums in another order for each column; the first column's stand for all
        low_w, low_p = w - before_w[segment], p - np.concatenate([np.zeros((width, 1)), p[:, ends[:-1]]], axis=1)[:, segment]
        values = x[at, columns]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low_p**2 / (low_w + penalty) + (all_p[segment] - low_p) ** 2 / (all_w[segment] - low_w + penalty)
        possible = np.zeros(gain.shape, bool)
        possible[:, :-1] = (values[:, 1:] > values[:, :-1]) & (segment[1:] == segment[:-1])
        unit = 1e-9 * np.maximum(np.add.reduceat(squares[at[0]], starts), 1e-290)
        gain = np.rint(gain / unit[segment])  # rounding noise must not decide between equal gains
        gain[~possible] = -np.inf
        best = gain.max(axis=0)
        top = np.maximum.reduceat(best, starts)
        cut = top * unit - all_p**2 / (all_w + penalty)
        split = cut > unit
        if not split.any():
            break
        found = np.flatnonzero(best == top[segment])
        place = found[np.unique(segment[found], return_index=True)[1]][split]
        column = gain[:, place].argmax(axis=0)
        below, above = values[column, place], values[column, place + 1]
        middle = below + (above - below) / 2
        border = np.where(middle < above, middle, below)
        parent = here[starts][split]
        child = size + 2 * np.arange(len(parent))
        kinds = [np.concatenate(c) for c in (feature, threshold, left, of)]
        kinds[0][parent], kinds[1][parent], kinds[2][parent] = column, border, child
        np.add.at(gains, (kinds[3][parent], column), cut[split])
        feature, threshold = [kinds[0], np.full(2 * len(parent), -1)], [kinds[1], np.zeros(2 * len(parent))]
        left, of = [kinds[2], np.full(2 * len(parent), -1)], [kinds[3], np.repeat(kinds[3][parent], 2)]
        size += 2 * len(parent)
        down = np.concatenate(left)
        moving = down[node] >= 0
        f, t = np.concatenate(feature)[node[moving]], np.concatenate(threshold)[node[moving]]
        node[moving] = down[node[moving]] + (x[moving, f] > t)
        at = at[:, split[segment]]
        side = (node[at] - child[0]).astype(np.int16 if 2 * len(parent) < 1 << 15 else np.int64)
        at = np.take_along_axis(at, np.argsort(side, axis=1, kind="stable"), 1)
    counted = order[0]
    total_w = np.bincount(node[counted], weights=weight[counted], minlength=size)
    total_p = np.bincount(node[counted], weights=pull[counted], minlength=size)
    value = np.where(total_w > 0, rate * total_p / np.maximum(total_w + penalty, 1e-300), 0.0)
    down = np.concatenate(left)
    trees.blocks.append((np.concatenate(feature), np.concatenate(threshold), np.where(down < 0, -1, down + trees.n), value, np.concatenate(of)))
    trees.roots.append(np.arange(n_trees) + trees.n)
    trees.n += size
    return value[node]


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: list[int], at_once: int = 100) -> dict:
    """A forest on bootstrap rows: leaves carry their share of the mean, importances are averages of normalised gains."""
    out, chance, importance = Trees(), np.random.default_rng(seed), np.zeros(x.shape[1])
    for first in range(0, trees, at_once):
        n = min(at_once, trees - first)
        drawn = np.zeros((n, len(y)))
        np.add.at(drawn, (np.repeat(np.arange(n), len(y)), chance.integers(0, len(y), n * len(y))), 1.0)
        tree, row = np.nonzero(drawn)
        own, gains = x[row], np.zeros((n, x.shape[1]))
        grow(out, own, y[row], drawn[tree, row], sorted_rows(own, tree), tree, np.arange(n), depth, 0.0, 1.0 / trees, gains)
        out.blocks[-1] = (*out.blocks[-1][:4], np.zeros_like(out.blocks[-1][4]))  # one model
        importance += (gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0) / trees
    return {"intercept": 0.0, "importance": importance, **out.own(0)}


def boosting(xs: list[np.ndarray], ys: list[np.ndarray], rounds: int, depth: int, rate: float, seed: list[int], subsample: float = 1.0,
             penalty: float = 0.0) -> list[dict]:
    """Squared-error boosting from the mean, one model for each (x, y), a round of all of them at a time.

    With ``subsample`` each round sees a random part of the rows; the others are still served by its trees.
    """
    x, y = np.concatenate(xs), np.concatenate(ys)
    tree = np.repeat(np.arange(len(ys)), [len(one) for one in ys])
    mean = np.array([one.mean() for one in ys])
    out, chance, gains = Trees(), np.random.default_rng(seed), np.zeros((len(ys), x.shape[1]))
    order, weight, fitted = sorted_rows(x, tree), np.ones(len(y)), mean[tree]
    for _ in range(rounds):
        own = order
        if subsample < 1:
            live = chance.random(len(y)) < subsample
            own = order[live[order]].reshape(x.shape[1], -1)
        fitted = fitted + grow(out, x, y - fitted, weight, own, tree, np.arange(len(ys)), depth, penalty, rate, gains)
    return [{"intercept": float(mean[g]), "importance": gains[g], **out.own(g)} for g in range(len(ys))]
