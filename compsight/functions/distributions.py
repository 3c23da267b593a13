"""Tail probabilities for the handful of test statistics a fit produces.

These run on the driver over O(d) numbers (never over rows).  Pure Python so
they also work where no JVM handle is available.  Algorithms: regularised
incomplete gamma (series / continued fraction) and incomplete beta
(modified Lentz continued fraction), both textbook.
"""

from __future__ import annotations

import math

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 500


def normal_sf(z: float) -> float:
    """P(Z > z) for a standard normal, accurate far into the tail."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def log_normal_cdf(z):
    """ln Φ of a NumPy array: a power series near 0, a continued fraction in the tails."""
    import numpy as np
    z = np.asarray(z, dtype="float64")
    a = np.abs(z)
    near = a < 3.0
    x = np.where(near, z, 0.0)
    term, total = x, x.copy()
    for k in range(1, 60):
        term = term * x * x / (2 * k + 1)
        total = total + term
    log_phi = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
    middle = 0.5 + np.exp(np.where(near, log_phi, 0.0)) * np.where(near, total, 0.0)
    y = np.where(near, 3.0, a)
    tail = y
    for k in range(60, 0, -1):
        tail = y + k / tail
    low = np.where(near, 0.0, log_phi) - np.log(tail)  # ln of the tail's probability
    return np.where(near, np.log(middle), np.where(z < 0, low, np.log1p(-np.exp(low))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _gamma_series(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x) by series (x < a + 1)."""
    ap, total, term = a, 1.0 / a, 1.0 / a
    for _ in range(_MAX_ITER):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) by continued fraction (x >= a + 1)."""
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chi2_sf(x: float, df: float) -> float:
    """P(X > x), X ~ chi-squared(df)."""
    if not math.isfinite(x):
        return 0.0 if x > 0 else 1.0
    return gamma_q(df / 2.0, x / 2.0)


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_ITER):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _beta_cf(b, a, 1.0 - x) / b


def beta_inc_upper(a: float, b: float, x: float) -> float:
    """1 - I_x(a, b) computed without cancellation."""
    return beta_inc(b, a, 1.0 - x)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f), F ~ F(d1, d2)."""
    if not math.isfinite(f):
        return 0.0 if f > 0 else 1.0
    if f <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    return beta_inc(d2 / 2.0, d1 / 2.0, x)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|), T ~ Student t(df)."""
    if not math.isfinite(t):
        return 0.0
    x = df / (df + t * t)
    return beta_inc(df / 2.0, 0.5, x)


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t CDF by bisection on the two-sided tail (used for CIs)."""
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def normal_quantile(p: float) -> float:
    """Inverse standard normal CDF by bisection on erfc (CI half-widths)."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if normal_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)
