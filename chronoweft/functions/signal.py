"""Numeric kernels that Spark has no operator for, on numpy arrays; used inside Arrow and pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatness(clip: np.ndarray) -> float:
    """Geometric over arithmetic mean of the power spectrum without its constant part; 1 for nothing or silence."""
    x = np.asarray(clip, np.float64)
    if x.size:
        x = x - x.mean()
    if not x.any():
        return 1.0
    power = np.square(np.abs(np.fft.rfft(x)))[1:] + 1e-18
    if not power.size:
        return 1.0
    return float(np.clip(math.exp(float(np.log(power).mean())) / power.mean(), 0.0, 1.0))


@F.pandas_udf(T.DoubleType())
def flatness_udf(clips: pd.Series) -> pd.Series:
    return clips.map(lambda c: 1.0 if c is None else flatness(c))


def ncc(search: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Normalised correlation at every lag where the feature fits; -1 where either side is flat."""
    s, f = np.asarray(search, np.float64), np.asarray(feature, np.float64)
    m, lags = f.size, s.size - f.size + 1
    if m == 0 or lags <= 0:
        return np.empty(0)
    f = f - f.mean()
    size = float(np.sqrt(f @ f))
    if size <= 1e-12:
        return np.full(lags, -1.0)
    if m * lags <= 1 << 16:
        top = np.correlate(s, f, "valid")
    else:
        n = 1 << int(s.size + m - 2).bit_length()
        top = np.fft.irfft(np.fft.rfft(s, n) * np.conj(np.fft.rfft(f, n)), n)[:lags]
    total, square = (np.concatenate(([0.0], np.cumsum(a))) for a in (s, s * s))
    spread = (square[m:] - square[:-m]) - (total[m:] - total[:-m]) ** 2 / m
    width = np.sqrt(np.maximum(spread, 0.0))
    return np.where(width <= 1e-12, -1.0, top / np.where(width <= 1e-12, 1.0, width * size))


def gcc_phat(search: np.ndarray, feature: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    """Correlation of the phases alone (Knapp and Carter, 1976) at every lag where the feature fits."""
    s, f = np.asarray(search, np.float64), np.asarray(feature, np.float64)
    lags = s.size - f.size + 1
    if f.size == 0 or lags <= 0:
        return np.empty(0)
    n = 1 << int(s.size + f.size - 2).bit_length()
    cross = np.fft.rfft(s, n) * np.conj(np.fft.rfft(f, n))
    return np.fft.irfft(cross / np.maximum(np.abs(cross), epsilon), n)[:lags]


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Positions of strict local maxima; a flat top counts once, at its middle, and not at an edge."""
    if x.size < 3:
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
    ends = np.concatenate((starts[1:], [x.size])) - 1
    level = x[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])] if inner.size else inner
    return (starts[top] + ends[top]) // 2


def prominence(x: np.ndarray, at: int) -> tuple[float, float]:
    """(prominence, width at half of it) of one peak: how far it stands above the higher
    of the two lowest points on its sides, each side reaching up to higher ground."""
    left, right = np.flatnonzero(x[:at] > x[at]), np.flatnonzero(x[at + 1 :] > x[at])
    a = int(left[-1]) + 1 if left.size else 0
    b = at + 1 + int(right[0]) if right.size else x.size
    height = float(x[at] - max(x[a : at + 1].min(), x[at:b].min()))
    level = x[at] - height / 2

    def crossing(side: np.ndarray, step: int) -> float:
        below = np.flatnonzero(side < level)
        if not below.size:
            return float(side.size - 1)
        k = int(below[0])
        return k - (level - side[k]) / (side[k - 1] - side[k]) if k else 0.0

    return height, float(crossing(x[a : at + 1][::-1], -1) + crossing(x[at:b], 1)) if height > 0 else 0.0


def peak_report(scores: np.ndarray, exclusion: int) -> dict | None:
    """The best peak of a score sequence and the next one more than ``exclusion`` away.

    The ends count as peaks; of equal ones the earliest is best.
    """
    x = np.asarray(scores, np.float64)
    if not x.size:
        return None
    inner = local_maxima(x)
    every = np.unique(np.concatenate((inner, [0, x.size - 1])))
    order = every[np.lexsort((every, -x[every]))]
    best = int(order[0])
    if best in inner:
        height, width = prominence(x, best)
        flat = np.flatnonzero(x[:best][::-1] != x[best]), np.flatnonzero(x[best + 1 :] != x[best])
        plateau = 1 + (int(flat[0][0]) if flat[0].size else best) + (int(flat[1][0]) if flat[1].size else x.size - 1 - best)
    else:
        height, width, plateau = float(x[best] - x.min()), 0.0, 0
    far = order[1:][np.abs(order[1:] - best) > exclusion]
    second = int(far[0]) if far.size else None
    return {
        "best_score": float(x[best]),
        "best_lag": best,
        "second_score": None if second is None else float(x[second]),
        "second_lag": second,
        "margin": None if second is None else float(x[best] - x[second]),
        "prominence": height,
        "width_samples": width,
        "plateau_samples": float(plateau),
    }


def _ratio(source: int, target: int) -> tuple[int, int]:
    if source <= 0 or target <= 0:
        raise ValueError("sample rates must be positive")
    g = math.gcd(source, target)
    return target // g, source // g


def resample_reach(source: int, target: int) -> int:
    """Samples on either side that the low pass of :func:`resample` looks at."""
    up, down = _ratio(source, target)
    return 0 if up == down else 10 * max(up, down) // up + 2


def resample(x: np.ndarray, source: int, target: int, part: tuple[int, int, int] | None = None):
    """Rational resampling by a zero-phase Kaiser-windowed low pass; the same array for equal rates.

    With ``part`` (a, i, j), ``x`` is a series from its sample ``a`` on, and the
    result is (number of the first sample, samples) for what i to j becomes.
    """
    up, down = _ratio(source, target)
    x = np.asarray(x)
    a, i, j = part or (0, 0, len(x))
    if up == down:
        return (i, x[i - a : j - a]) if part else x
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    first = -(-i * up // down)
    # output n is centred at n * down on the grid that is finer by ``up``
    centre = np.arange(first, -(-j * up // down)) * down
    out = np.zeros(len(centre))
    x = x.astype(np.float64)
    nearest = centre // up
    for d in range(-(half // up + 1), half // up + 2):
        at = nearest + d
        tap = centre - at * up
        ok = (at >= a) & (at - a < len(x)) & (np.abs(tap) <= half)
        out[ok] += x[at[ok] - a] * taps[tap[ok] + half]
    return (first, out) if part else out


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knot slopes of the monotone cubic (Fritsch and Butland, 1984)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    m = np.zeros(len(x))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
    m[1:-1] = np.where(same, inner, 0.0)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return m


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives of the monotone cubic; the end cubics go on outside."""
    x, y, at = (np.asarray(v, np.float64) for v in (x, y, at))
    m = pchip_slopes(x, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t, d = (at - x[k]) / h, (y[k + 1] - y[k]) / h
    c2, c3 = 3 * d - 2 * m[k] - m[k + 1], m[k] + m[k + 1] - 2 * d
    return y[k] + h * t * (m[k] + t * (c2 + t * c3)), m[k] + t * (2 * c2 + 3 * t * c3)


def regrid(x: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation of a series on ``n`` evenly spaced places."""
    if len(x) == 0 or n <= 0:
        return np.zeros(max(n, 0))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


def kalman_filter(t, z, noise, start, prior, offset_power: float, rate_power: float) -> np.ndarray:
    """Filtered [offset, rate] states of one series, a row for each observation.

    Columns: offset, rate, p00, p01, p11 after the observation, and the same before
    it.  ``start`` is the state before the first observation and ``prior`` its two
    variances; the powers are variances gained in a second.
    """
    o, r = start
    p00, p01, p11 = prior[0], 0.0, prior[1]
    out = np.empty((len(t), 10))
    for i, (now, seen, n) in enumerate(zip(np.asarray(t, float).tolist(), np.asarray(z, float).tolist(), np.asarray(noise, float).tolist())):
        if i:
            dt = now - before
            o += dt * r
            p00 += dt * (2 * p01 + dt * p11) + offset_power * dt + rate_power * dt**3 / 3
            p01 += dt * p11 + rate_power * dt * dt / 2
            p11 += rate_power * dt
        before = now
        ahead = (o, r, p00, p01, p11)
        k0, k1 = p00 / (p00 + n), p01 / (p00 + n)
        gap = seen - o
        o, r, p00, p01, p11 = o + k0 * gap, r + k1 * gap, (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        out[i] = (o, r, p00, p01, p11, *ahead)
    return out


def kalman_smoother(t, states: np.ndarray, check=None) -> np.ndarray:
    """Smoothed offset, rate, p00, p01, p11 (Rauch, Tung and Striebel, 1965) of the rows of :func:`kalman_filter`.

    ``check(i, matrix)`` sees every predicted covariance that is inverted.
    """
    out = states[:, :5].copy()
    t = np.asarray(t, float)
    for i in range(len(t) - 2, -1, -1):
        f = np.array([[1.0, t[i + 1] - t[i]], [0.0, 1.0]])
        own, nxt, late = states[i], states[i + 1], out[i + 1]
        p, q = (np.array([[x[0], x[1]], [x[1], x[2]]]) for x in (own[2:5], nxt[7:10]))
        if check:
            check(i + 1, q)
        g = np.linalg.solve(q, f @ p).T
        moved = own[:2] + g @ (late[:2] - nxt[5:7])
        c = p + g @ (np.array([[late[2], late[3]], [late[3], late[4]]]) - q) @ g.T
        out[i] = (*moved, c[0, 0], (c[0, 1] + c[1, 0]) / 2, c[1, 1])
    return out
