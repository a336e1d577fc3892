"""Upper tail of the F distribution, vectorised for use on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients B(2k) / (2k (2k-1)) of Stirling's series for ln(gamma).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156, -3617 / 122400)
_STIRLING_FROM = 16.0
# Beyond these the continued fraction gives way to expansions: both halves of the degrees of freedom, or one.
LARGE, HUGE = 1e6, 1e7


def _tail_series(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) minus its leading terms, for large x."""
    out = np.zeros_like(x)
    for c in reversed(_STIRLING):
        out = out / (x * x) + c
    return out / x


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raise x above the series limit; return it with ln of the product left behind."""
    left = np.zeros_like(x)
    x = x.copy()
    low = x < _STIRLING_FROM
    while low.any():
        left[low] += np.log(x[low])
        x[low] += 1.0
        low = x < _STIRLING_FROM
    return x, left


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, left = _shifted(np.asarray(x, dtype=float))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + _tail_series(x) - left


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln B(a, b), also accurate when one argument is huge and the other small."""
    a, b = np.maximum(a, b), np.minimum(a, b)
    big = a >= _STIRLING_FROM
    safe = np.where(big, a, _STIRLING_FROM)
    # ln gamma(a + b) - ln gamma(a), term by term so nothing large cancels
    ratio = ((safe - 0.5) * np.log1p(b / safe) + b * np.log(safe + b) - b
             + _tail_series(safe + b) - _tail_series(safe))
    return log_gamma(b) - np.where(big, ratio, log_gamma(a + b) - log_gamma(a))


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300

    def guarded(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guarded(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    m = 1
    open_ = np.ones(x.shape, dtype=bool)
    while open_.any():
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guarded(1.0 + even * d)
        c = guarded(1.0 + even / c)
        h = np.where(open_, h * d * c, h)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guarded(1.0 + odd * d)
        c = guarded(1.0 + odd / c)
        step = d * c
        h = np.where(open_, h * step, h)
        open_ &= np.abs(step - 1.0) > 1e-15
        m += 1
    return h


def _gamma_upper(b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(b, z), z > 0."""
    out = np.ones_like(z)
    front = np.exp(b * np.log(z) - z - log_gamma(b))
    low = z < b + 1
    if low.any():
        term = 1 / b[low]
        total, n = term.copy(), 0
        while (term > 1e-17 * total).any():
            n += 1
            term = term * z[low] / (b[low] + n)
            total += term
        out[low] = 1 - front[low] * total
    high = ~low
    if high.any():
        bh, zh = b[high], z[high]
        base = zh + 1 - bh
        c, d = np.full_like(base, 1e300), 1 / base
        h, n = d.copy(), 0
        open_ = np.ones(h.shape, dtype=bool)
        while open_.any():
            n += 1
            step = -n * (n - bh)
            base = base + 2
            d = 1 / np.where(np.abs(step * d + base) < 1e-300, 1e-300, step * d + base)
            c = np.where(np.abs(base + step / c) < 1e-300, 1e-300, base + step / c)
            h = np.where(open_, h * c * d, h)
            open_ &= np.abs(c * d - 1) > 1e-15
        out[high] = front[high] * h
    return out


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function, from Q(1/2, x * x)."""
    q = _gamma_upper(np.full_like(x, 0.5), np.maximum(x * x, 1e-300))
    return np.where(x >= 0, q, 2 - q)


def _both_large(log_x: np.ndarray, log_y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) for two large parameters: uniform normal approximation with its first correction."""
    n, x0 = a + b, a / (a + b)
    y0 = b / (a + b)
    # with x = x0 (1 + u): half the square of eta, without cancellation near the middle
    u, v = np.expm1(log_x - np.log(x0)), np.expm1(log_y - np.log(y0))
    half = x0 * (u - np.log1p(u)) + y0 * (v - np.log1p(v))
    eta = np.sign(u) * np.sqrt(2 * np.maximum(half, 0))
    middle = np.abs(eta) < 1e-3
    safe = np.where(middle, 1.0, eta)
    shift = np.where(middle, 1.0, x0 * u)
    correction = np.where(middle, (1 - 2 * x0) / (3 * np.sqrt(x0 * y0)), 1 / safe - np.sqrt(x0 * y0) / shift)
    return (0.5 * _erfc(-eta * np.sqrt(n / 2))
            + np.exp(-0.5 * eta * eta * n) / np.sqrt(2 * np.pi * n) * correction)


def f_upper_tail(f, d1, d2) -> np.ndarray:
    """P(F > f) with d1 and d2 degrees of freedom; NaN where undefined."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    out = np.full(f.shape, np.nan)
    defined = ~np.isnan(f) & (d1 > 0) & (d2 > 0)
    out[defined & (f <= 0)] = 1.0
    todo = defined & (f > 0)
    if not todo.any():
        return out
    r, a, b = d1[todo] * f[todo] / d2[todo], d2[todo] / 2, d1[todo] / 2
    # p = I_x(a, b) with x = 1 / (1 + r)
    x, y = 1 / (1 + r), r / (1 + r)
    log_x = -np.log1p(r)
    log_y = np.where(r > 1, -np.log1p(1 / r), np.log(r) - np.log1p(r))
    p = np.ones_like(x)
    normal = np.minimum(a, b) > LARGE
    if normal.any():
        p[normal] = _both_large(log_x[normal], log_y[normal], a[normal], b[normal])
    # one huge parameter: the chi-square limit with its first correction
    chi = ~normal & (a > HUGE)
    if chi.any():
        p[chi] = _gamma_upper(b[chi], np.maximum((a[chi] + (b[chi] - 1) / 2) * -log_x[chi], 1e-300))
    chi_y = ~normal & ~chi & (b > HUGE)
    if chi_y.any():
        p[chi_y] = 1 - _gamma_upper(a[chi_y], np.maximum((b[chi_y] + (a[chi_y] - 1) / 2) * -log_y[chi_y], 1e-300))
    exact = ~(normal | chi | chi_y)
    front = np.where(exact, np.exp(np.where(exact, a * log_x + b * log_y - log_beta(a, b), 0.0)), 0.0)
    below = x < (a + 1) / (a + b + 2)
    direct = exact & below
    if direct.any():
        p[direct] = front[direct] / a[direct] * _beta_fraction(x[direct], a[direct], b[direct])
    other = exact & ~below
    if other.any():
        p[other] = 1 - front[other] / b[other] * _beta_fraction(y[other], b[other], a[other])
    out[todo] = np.clip(p, 0.0, 1.0)
    return out


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Column function: upper tail of F(d1, d2) at ``f``; NULL where undefined."""
    return pd.Series(f_upper_tail(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))
