"""Distribution functions in numpy: normal, gamma, chi-square, Student, Kolmogorov. Accurate to about 1e-8 or better."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x):
    return 0.5 * (1.0 + _erf(np.asarray(x, float) / math.sqrt(2.0)))


def norm_pdf(x):
    x = np.asarray(x, float)
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def norm_ppf(p):
    """Inverse normal by Newton steps from a logistic start; p is kept within 1e-300 of 0 and 1."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = -(t - (np.log(t) + 0.5 * np.log(2 * math.pi)) / np.maximum(t, 1e-9))
    x = np.where(q > 0.02, (q - 0.5) * math.sqrt(2 * math.pi), x)
    for _ in range(60):
        step = (norm_cdf(x) - q) / np.maximum(norm_pdf(x), 1e-300)
        step = np.clip(step / (1 + 0.5 * x * np.clip(step, -1, 1)), -1, 1)
        x = x - step
        if np.max(np.abs(step), initial=0.0) < 1e-13:
            break
    return np.where(p <= 0.5, x, -x)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    log = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(log)
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1.0 - math.exp(log) * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 - gamma_p(df / 2, x / 2)


def t_cdf(x: float, df: float) -> float:
    """Student's distribution by Simpson's rule on a bounded substitution."""
    theta = math.atan2(abs(x), math.sqrt(df))
    n = 2000
    grid = np.linspace(0.0, theta, n + 1)
    f = np.cos(grid) ** (df - 1)
    integral = (theta / n / 3) * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(const * integral, x)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_cdf_all(x: np.ndarray, df: float, step: int = 4096) -> np.ndarray:
    """t_cdf of many values at once, by Gauss-Legendre; step values at a time, so memory is bounded."""
    x = np.asarray(x, float)
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    out = np.empty(len(x))
    for i in range(0, len(x), step):
        half = np.arctan2(np.abs(x[i : i + step]), math.sqrt(df)) / 2
        integral = half * (np.cos(half[:, None] * (_NODES + 1)) ** (df - 1) @ _WEIGHTS)
        out[i : i + step] = 0.5 + np.copysign(const * integral, x[i : i + step])
    return out


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def ks_statistic(x: np.ndarray, cdf: np.ndarray) -> float:
    """Largest distance of the empirical distribution of sorted x from the model's values at x."""
    n = len(x)
    up = np.arange(1, n + 1) / n
    return float(max((up - cdf).max(), (cdf - up + 1 / n).max()))


def ks_pvalue(d: float, n: int) -> float:
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def nelder_mead(f, x0, step: float = 0.1, tol: float = 1e-9, most: int = 2000) -> np.ndarray:
    """Minimum of f by a simplex; deterministic."""
    n = len(x0)
    pts = [np.array(x0, float)] + [np.array(x0, float) + np.eye(n)[i] * (step * max(1.0, abs(x0[i]))) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(most):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        vf = f(far)
        if vf < val[0]:
            further = mid + 2 * (mid - pts[-1])
            vg = f(further)
            pts[-1], val[-1] = (further, vg) if vg < vf else (far, vf)
        elif vf < val[-2]:
            pts[-1], val[-1] = far, vf
        else:
            near = mid + 0.5 * ((far if vf < val[-1] else pts[-1]) - mid)
            vn = f(near)
            if vn < min(vf, val[-1]):
                pts[-1], val[-1] = near, vn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]
