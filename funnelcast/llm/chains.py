"""Scaled forward-backward over many sequences at once."""

from __future__ import annotations

import numpy as np

from . import words

_BLOCK = 1 << 17


def _forward(e: np.ndarray, start: np.ndarray, move: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward weights and the scale of each slot; ``e`` holds the potentials by slots (see :func:`words.time_major`)."""
    alpha, scale, one = np.empty_like(e), np.empty(len(e), np.float32), np.ones(len(start), np.float32)
    before = 0
    for t, (a, b) in enumerate(zip(bounds, bounds[1:])):
        x = alpha[a:b]
        if t == 0:
            np.multiply(e[a:b], start, out=x)
        else:
            alpha[before : before + b - a].dot(move, x)
            x *= e[a:b]
        s = scale[a:b]
        x.dot(one, s)
        x /= s[:, None]
        before = a
    return alpha, scale


def _backward(e: np.ndarray, alpha: np.ndarray, scale: np.ndarray, move: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed pair and first marginals; the marginals of each slot take the place of the potentials ``e``."""
    k = len(move)
    beyond, turned = np.empty_like(e), np.ascontiguousarray(move.T)  # beyond: weight of the next tokens times this token's potential
    after = np.ones((bounds[1], k), np.float32)  # rows not written yet belong to sequences that end here
    for t in range(len(bounds) - 2, 0, -1):
        a, b = bounds[t], bounds[t + 1]
        eb, eab, back = beyond[a:b], e[a:b], after[: b - a]
        np.multiply(eab, back, eb)
        eb /= scale[a:b, None]
        np.multiply(alpha[a:b], back, eab)
        eb.dot(turned, back)
    np.multiply(alpha[: bounds[1]], after, out=e[: bounds[1]])
    widths = np.diff(bounds)
    later = np.arange(bounds[1], bounds[-1])
    earlier = later - np.repeat(widths[:-1], widths[1:])  # the same sequence one step before
    pairs = np.zeros((k, k))
    for first in range(0, len(later), _BLOCK):
        some = slice(first, first + _BLOCK)
        pairs += np.dot(alpha.take(earlier[some], axis=0, mode="clip").T, beyond[bounds[1] :][some])
    return pairs * move, e[: bounds[1]].sum(0, dtype=np.float64)


def _weights(scale: np.ndarray, order: np.ndarray, border: np.ndarray, sequences: int) -> np.ndarray:
    """Log weight of each sequence."""
    ll = np.zeros(sequences)
    rank = np.arange(len(scale)) - np.repeat(border[:-1], np.diff(border))
    ll[order] = np.bincount(rank, weights=np.log(scale.astype(np.float64)), minlength=sequences)
    return ll


def smooth(potentials: np.ndarray, start: np.ndarray, move: np.ndarray, lens: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log weight of each sequence, marginals of each token, summed pair marginals, summed first marginals.

    ``potentials`` holds a positive row for each token, sequences one after another. Sequences run side by
    side, longest first; scaling each step keeps numbers in range and gives the exact log weight. Without
    ``backward`` the last three are empty.
    """
    k = len(start)
    none = np.empty((0, k), np.float32), np.zeros((k, k)), np.zeros(k)
    order, token, border = words.time_major(lens)
    if not len(token):
        return np.zeros(len(lens)), *none
    e, bounds = potentials.astype(np.float32, copy=False)[token], border.tolist()
    start, move = start.astype(np.float32), move.astype(np.float32)
    alpha, scale = _forward(e, start, move, bounds)
    ll = _weights(scale, order, border, len(lens))
    if not backward:
        return ll, *none
    pairs, first = _backward(e, alpha, scale, move, bounds)
    marginals = alpha  # done with: its room is taken
    marginals[token] = e
    return ll, marginals, pairs, first


def log_weights(table: np.ndarray, classes: np.ndarray, start: np.ndarray, move: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Log weight of each sequence of ``classes``; a token's potentials are the row of its class in ``table``."""
    order, token, border = words.time_major(lens)
    if not len(token):
        return np.zeros(len(lens))
    e = table.astype(np.float32).take(classes.take(token), axis=0, mode="clip")
    scale = _forward(e, start.astype(np.float32), move.astype(np.float32), border.tolist())[1]
    return _weights(scale, order, border, len(lens))


def expected(table: np.ndarray, classes: np.ndarray, start: np.ndarray, move: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals summed by class, pair marginals and first marginals; arguments as for :func:`log_weights`."""
    size, k = table.shape
    sums = np.zeros((size, k))
    _, token, border = words.time_major(lens)
    if not len(token):
        return sums, np.zeros((k, k)), np.zeros(k)
    of, bounds = classes.take(token), border.tolist()  # sums need no order of tokens: all goes by slots
    e = table.astype(np.float32).take(of, axis=0, mode="clip")
    start, move = start.astype(np.float32), move.astype(np.float32)
    alpha, scale = _forward(e, start, move, bounds)
    pairs, first = _backward(e, alpha, scale, move, bounds)
    for j in range(k):
        sums[:, j] = np.bincount(of, weights=e[:, j], minlength=size)
    return sums, pairs, first
