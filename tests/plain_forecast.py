"""The forecast models as plain numpy over one series, an independent check of the folds."""

import math

import numpy as np

from tablewise.operators.forecast import AVERAGE, HOLT, HOLT_ALPHA, HOLT_BETA, HOLT_WINTERS, HW_ALPHA, HW_BETA, HW_GAMMA, NAIVE, TREND, Z80, Z95


def _naive(y, h, season):
    return np.r_[y[0], y[:-1]], np.full(h, y[-1])


def _average(y, h, season):
    sums = np.convolve(y, np.ones(3), "valid") / 3 if len(y) >= 3 else np.array([])
    fit = y.astype(float).copy()
    fit[3:] = sums[:-1] if len(y) > 3 else fit[3:]
    return fit, np.full(h, y[-3:].mean())


def _trend(y, h, season):
    x = np.arange(len(y), dtype=float)
    dx = x - x.mean()
    spread = (dx * dx).sum()
    slope = (dx * (y - y.mean())).sum() / spread if spread else 0.0
    base = y.mean() - slope * x.mean()
    return base + slope * x, base + slope * (len(y) + np.arange(h))


def _smooth_grid(y, alpha, beta, gamma, season):
    """Level, trend and seasonal states of every parameter choice at once (one lane per choice).

    Without a season the seasonal term stays zero and the first value starts the level.
    """
    lanes = len(alpha)
    n = len(y)
    fit = np.empty((n, lanes))
    if season:
        first, second = y[:season].mean(), y[season:2 * season].mean()
        level, trend = np.full(lanes, first), np.full(lanes, (second - first) / season)
        cycle = np.repeat((y[:season] - first)[:, None], lanes, axis=1)
        fit[:season] = y[:season, None]
        start = season
    else:
        level, trend = np.full(lanes, y[0]), np.full(lanes, y[1] - y[0] if n > 1 else 0.0)
        cycle = np.zeros((1, lanes))
        fit[0] = y[0]
        start = 1
    for i in range(start, n):
        s = cycle[i % len(cycle)]
        expected = level + trend
        fit[i] = expected + s
        fresh = alpha * (y[i] - s) + (1 - alpha) * expected
        trend = beta * (fresh - level) + (1 - beta) * trend
        if season:
            cycle[i % season] = gamma * (y[i] - fresh) + (1 - gamma) * s
        level = fresh
    return fit, level, trend, cycle, start


def _smoothed(y, h, season, grid):
    alpha, beta, gamma = (np.array(v) for v in zip(*grid))
    fit, level, trend, cycle, start = _smooth_grid(y, alpha, beta, gamma, season)
    misses = ((y[start if season else 0:, None] - fit[start if season else 0:]) ** 2).sum(axis=0)
    best = int(np.argmin(misses))
    ahead = np.arange(1, h + 1)
    future = level[best] + ahead * trend[best]
    if season:
        future = future + np.array([cycle[(len(y) + k) % season, best] for k in range(h)])
    return fit[:, best], future


def _holt(y, h, season):
    return _smoothed(y, h, 0, [(a, b, 0.0) for a in HOLT_ALPHA for b in HOLT_BETA])


def _holt_winters(y, h, season):
    if len(y) < 2 * season:
        return None
    return _smoothed(y, h, season, [(a, b, g) for a in HW_ALPHA for b in HW_BETA for g in HW_GAMMA])


def candidates(n: int, h: int, season: int | None) -> list:
    models = [(NAIVE, _naive), (AVERAGE, _average), (TREND, _trend), (HOLT, _holt)]
    if season and n >= 2 * season + max(3, h):
        models.append((HOLT_WINTERS, _holt_winters))
    return models


def score(y: np.ndarray, h: int, season: int | None) -> list[tuple]:
    """(name, model, rmse, mape) on the held-out tail, best first."""
    hold = max(1, min(h, len(y) // 4))
    train, test = y[:-hold], y[-hold:]
    out = []
    for name, model in candidates(len(y), h, season):
        made = model(train, hold, season) if len(train) >= 3 else None
        if made is None:
            out.append((name, model, math.inf, None))
            continue
        miss = test - made[1]
        share = np.where(test != 0, np.abs(miss / np.where(test != 0, test, 1.0)), 0.0)
        out.append((name, model, float(np.sqrt((miss ** 2).mean())), float(share.mean())))
    return sorted(out, key=lambda c: c[2])


def fit_series(values, h: int = 6, season: int | None = None) -> dict:
    """Best holdout model refitted on everything, with 80 % and 95 % bands."""
    y = np.asarray(values, dtype=float)
    ranked = score(y, h, season)
    name, model, rmse, _ = ranked[0]
    fit, future = model(y, h, season)
    skip = min(season or 1, len(y) - 3) if name == HOLT_WINTERS else 1
    left = (y - fit)[skip:]
    inside = float(np.sqrt((left ** 2).mean())) if len(left) else 0.0
    sigma = max(inside, rmse if math.isfinite(rmse) else 0.0) or float(y.std(ddof=1)) * 0.1
    width = sigma * np.sqrt(np.arange(1, h + 1))
    floor = (lambda x: np.maximum(0.0, x)) if (y >= 0).all() else (lambda x: x)
    return {"method": name, "forecast": future, "lo80": floor(future - Z80 * width), "hi80": future + Z80 * width,
            "lo95": floor(future - Z95 * width), "hi95": future + Z95 * width, "sigma": sigma, "fitted": fit,
            "comparison": [(c[0], c[2], c[3]) for c in ranked]}
