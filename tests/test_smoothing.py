"""Estimated start values against plain least squares and a plain recursion."""

from __future__ import annotations

import numpy as np
import pytest

from funnelcast.operators import smoothing as S


def plain(ys, a, b, g, level, trend, season):
    """The textbook recursion; returns the one-step predictions and the states after the last month."""
    season, out = list(season), []
    for t, y in enumerate(ys):
        s = season[t % len(season)] if season else 0.0
        out.append(level + trend + s)
        new = a * (y - s) + (1 - a) * (level + trend)
        if season:
            season[t % len(season)] = g * (y - level - trend) + (1 - g) * s
        level, trend = new, b * (new - level) + (1 - b) * trend
    return np.array(out), level, trend, season


@pytest.fixture(scope="module")
def ys():
    rng = np.random.default_rng(1)
    t = np.arange(40)
    return 100 + 2 * t + 20 * np.sin(t * np.pi / 2) + rng.normal(0, 4, 40)


def test_coefficients_reproduce_the_recursion(ys):
    rng = np.random.default_rng(2)
    triples = rng.uniform(0.05, 0.9, (5, 3))
    x, level, trend, season = S.coefficients(ys, triples, 4)
    start = rng.normal(10, 5, 6)
    for i, (a, b, share) in enumerate(triples):
        got, lv, tr, se = plain(ys, a, b, share * (1 - a), start[0], start[1], start[2:])
        at = np.append(start, 1.0)
        assert np.allclose(x[:, i] @ at, got) and np.isclose(level[i] @ at, lv) and np.isclose(trend[i] @ at, tr)
        assert np.allclose(season[:, i] @ at, se)


def test_start_values_are_least_squares(ys):
    x = S.coefficients(ys, S.GRID[:7], 4)[0]
    start, sse = S.start_values(x, ys)
    for i in range(7):
        best = np.linalg.lstsq(x[:, i, :-1], ys - x[:, i, -1], rcond=1e-9)[0]
        want = ((ys - x[:, i, -1] - x[:, i, :-1] @ best) ** 2).sum()
        assert sse[i] == pytest.approx(want, rel=1e-5)


def test_fit_beats_the_grid_and_does_not_look_ahead(ys):
    fits = {f["origin"]: f for f in S.fit(ys, [5, 20, 30, 40], 4)}
    alone = {f["origin"]: f for f in S.fit(ys[:30], [20, 30], 4)}
    for o in (20, 30):
        assert fits[o] == pytest.approx(alone[o]) if not isinstance(fits[o]["season"], list) else all(
            np.allclose(fits[o][k], alone[o][k], rtol=1e-6, atol=1e-6) for k in fits[o])
        x = S.coefficients(ys[:o], S.GRID, 4)[0]
        assert fits[o]["sse"] <= S.start_values(x, ys[:o])[1].min() * (1 + 1e-9)
    assert fits[5]["season"] == [0.0] * 4 and fits[5]["gamma"] == 0.0


def test_states_continue_the_series(ys):
    exact = 50 + 3.0 * np.arange(24) + np.tile([5.0, -5.0, 2.0, -2.0], 6)
    (f,) = S.fit(exact, [24], 4)
    ahead = [f["level"] + h * f["trend"] + f["season"][(h - 1) % 4] for h in range(1, 6)]
    assert np.allclose(ahead, 50 + 3.0 * np.arange(24, 29) + np.array([5.0, -5.0, 2.0, -2.0, 5.0]), atol=1e-2) and f["sse"] < 1e-2


def test_short_series():
    assert S.fit(np.array([1.0, 2.0]), [1, 2], 12) == []
    (f,) = S.fit(np.array([1.0, 2.0, 3.0]), [3], 12)
    assert f["level"] + f["trend"] == pytest.approx(4, abs=1e-2)
    (flat,) = S.fit(np.full(30, 7.0), [30], 12)
    assert flat["level"] + flat["trend"] + flat["season"][0] == pytest.approx(7, abs=1e-3)
