"""Additive exponential smoothing of one series with estimated start values (the in-task part of Holt-Winters).

For given smoothing weights every state and one-step prediction is an affine function of the start values (level,
trend, one seasonal value for each month of a cycle). So the recursion runs on coefficient vectors, for many triples
of weights at once, and the best start values are a small least squares solve; the normal equations of an origin are
sums over the months up to it. The weights come from a coarse grid, then a pattern search around its best point.
"""

from __future__ import annotations

from itertools import product

import numpy as np

GRID = np.array(list(product((0.02, 0.1, 0.25, 0.5, 0.75, 0.95), (0.01, 0.1, 0.4, 0.9), (0.02, 0.1, 0.3, 0.6))))
LOW, HIGH = 1e-4, 1 - 1e-4
MOVES = np.array([m for m in product((-1, 0, 1), repeat=3)])


def coefficients(ys: np.ndarray, triples: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step predictions as (months, triples, start values + 1) coefficients, and the last level, trend and seasons.

    ``triples`` holds weights of level, trend and season (the season's as a share of 1 - level's); ``period`` 0: no season.
    """
    a, b = triples[:, :1], triples[:, 1:2]
    g = triples[:, 2:] * (1 - a)
    width = 3 + period
    level, trend = np.zeros((len(triples), width)), np.zeros((len(triples), width))
    season = np.zeros((max(period, 1), len(triples), width))
    level[:, 0] = trend[:, 1] = 1.0
    for j in range(period):
        season[j, :, 2 + j] = 1.0
    out = np.empty((len(ys), len(triples), width))
    for t, y in enumerate(ys):
        s = season[t % max(period, 1)]
        ahead = level + trend
        out[t] = ahead + s
        error = -out[t]
        error[:, -1] += y
        new = ahead + a * error
        trend = b * (new - level) + (1 - b) * trend
        level = new
        if period:
            season[t % period] = s + g * error
    return out, level, trend, season


def start_values(x: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares start values for each triple and the squared error they leave (``x``: :func:`coefficients` of ``ys``)."""
    lines, target = np.moveaxis(x[..., :-1], 0, 1), (ys[:, None] - x[..., -1]).T
    gram, pull = lines.transpose(0, 2, 1) @ lines, (target[:, None, :] @ lines)[:, 0, :]
    # level and seasons may shift against each other: a trace of a ridge picks the smallest of equal solutions
    ridge = 1e-9 * np.trace(gram, axis1=1, axis2=2)[:, None, None] * np.eye(gram.shape[1])
    start = np.linalg.solve(gram + ridge, pull[..., None])[..., 0]
    return start, ((target - (lines @ start[..., None])[..., 0]) ** 2).sum(axis=1)


def fit(ys: np.ndarray, origins: list[int], period: int) -> list[dict]:
    """Best fit to the first months up to each origin: weights, squared error, and level, trend and seasons after them.

    Origins below two cycles are fitted without a season; an origin below 3 has no fit (None).
    """
    out: list[dict] = []
    for cycle in (0, period):
        own = [o for o in origins if o >= 3 and (o >= 2 * period) == bool(cycle)]
        if not own:
            continue
        grid = GRID if cycle else np.unique(GRID * [1, 1, 0] + [0, 0, 0.5], axis=0)
        x = coefficients(ys[: max(own)], grid, cycle)[0]
        sse = [start_values(x[:o], ys[:o])[1] for o in own]
        best = np.array([grid[int(np.argmin(s))] for s in sse])
        least, step = np.array([s.min() for s in sse]), np.full(len(own), 0.12)
        for _ in range(14):
            tried = np.clip(best[:, None, :] + MOVES * step[:, None, None], LOW, HIGH)
            x = coefficients(ys[: max(own)], tried.reshape(-1, 3), cycle)[0]
            for i, o in enumerate(own):
                sse = start_values(x[:o, i * len(MOVES) : (i + 1) * len(MOVES)], ys[:o])[1]
                j = int(np.argmin(sse))
                if sse[j] < least[i] * (1 - 1e-9):
                    best[i], least[i] = tried[i, j], sse[j]
                else:
                    step[i] /= 2.5
        for i, o in enumerate(own):
            x, level, trend, season = coefficients(ys[:o], best[i : i + 1], cycle)
            start, sse = start_values(x, ys[:o])
            at = np.append(start[0], 1.0)
            seasons = [float(season[(o + h) % cycle, 0] @ at) for h in range(cycle)] if cycle else [0.0] * period
            alpha, beta, gamma = best[i]
            out.append({"origin": o, "sse": float(sse[0]), "alpha": float(alpha), "beta": float(beta),
                        "gamma": float(gamma * (1 - alpha)) if cycle else 0.0,
                        "level": float(level[0] @ at), "trend": float(trend[0] @ at), "season": seasons})
    return out
