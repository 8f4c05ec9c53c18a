"""Series models: each series is one group of applyInPandas, fitted in numpy; series run side by side.

A series is bounded by its time range (35,040 windows of 15 minutes a year), not by the number of raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mathx


def _series(pdf: pd.DataFrame, order: str, x: str) -> np.ndarray:
    v = pdf.sort_values(order)[x].to_numpy(float)
    return np.where(np.isfinite(v), v, 0.0)


def ols(a: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    return np.linalg.solve(a.T @ a + max(ridge, 1e-9) * np.eye(a.shape[1]), a.T @ y)


def ar_fit(x: np.ndarray, lags: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(constant and coefficients, residuals) of an autoregression on the given lags; too short a series has none."""
    p = max(lags)
    if len(x) <= p + len(lags) + 1:
        return np.zeros(len(lags) + 1), x - x.mean() if len(x) else x
    a = np.column_stack([np.ones(len(x) - p), *(x[p - k : len(x) - k] for k in lags)])
    beta = ols(a, x[p:])
    return beta, x[p:] - a @ beta


def ar_simulate(shocks: np.ndarray, beta: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    """The recursion run forward over shocks; coefficients whose absolute sum is 1 or more are scaled to be stable."""
    phi = beta[1:]
    s = np.abs(phi).sum()
    phi = phi * (0.995 / s) if s >= 1 else phi
    out = np.zeros(len(shocks))
    for t in range(len(shocks)):
        out[t] = beta[0] + shocks[t] + sum(c * out[t - k] for c, k in zip(phi, lags) if t >= k)
    return out


def garch_variance(e: np.ndarray, omega: float, alpha, beta, gamma: float = 0.0, kind: str = "garch") -> np.ndarray:
    """Conditional variances of GARCH(p,q), its asymmetric form (gamma weighs negative shocks) or EGARCH(1,1).

    alpha, beta: a number or the coefficients by lag. EGARCH is a recursion of log variances in the size and sign of the
    standardised shock: alpha weighs its size, gamma its sign.
    """
    a, c = np.atleast_1d(np.asarray(alpha, float)).tolist(), np.atleast_1d(np.asarray(beta, float)).tolist()
    start = max(1e-12, float(e.var())) if len(e) else 1.0
    x, h = e.tolist(), [start] * len(e)
    if kind == "egarch":
        mean, log_h = math.sqrt(2 / math.pi), math.log(start)
        for t in range(1, len(x)):
            z = x[t - 1] * math.exp(-0.5 * log_h)
            log_h = min(50.0, max(-50.0, omega + a[0] * (abs(z) - mean) + gamma * z + c[0] * log_h))
            h[t] = math.exp(log_h)
        return np.maximum(np.array(h), 1e-12)
    for t in range(1, len(x)):
        v = omega + (gamma * x[t - 1] ** 2 if x[t - 1] < 0 else 0.0)
        for k, w in enumerate(a, 1):
            v += w * (x[t - k] ** 2 if t >= k else start)
        for k, w in enumerate(c, 1):
            v += w * (h[t - k] if t >= k else start)
        h[t] = v
    return np.maximum(np.array(h), 1e-12)


#: Volatility forms: kind, lags of shocks, lags of variances.
FORMS = (("garch", 1, 1), ("garch", 1, 2), ("garch", 2, 1), ("garch", 2, 2), ("gjr", 1, 1), ("egarch", 1, 1))


def garch_fit(e: np.ndarray, cap: float = 0.995, forms: tuple = FORMS) -> dict:
    """The form and error distribution (normal, Student) of least AIC; persistence is kept under the cap.

    alpha, beta: the sums over lags; alphas, betas: by lag. Too short or flat a series has a constant variance.
    """
    e = e - e.mean() if len(e) else e
    var = float(e.var()) if len(e) else 0.0
    flat = {"kind": "constant", "errors": "normal", "omega": var, "alpha": 0.0, "beta": 0.0, "gamma": 0.0, "df": 0.0, "aic": math.inf, "persistence": 0.0, "alphas": [0.0], "betas": [0.0]}
    if len(e) < 50 or var <= 1e-12:
        return flat
    z = e / math.sqrt(var)
    sig = lambda v: 1 / (1 + math.exp(-min(30.0, max(-30.0, v))))

    def unpack(kind: str, p: int, q: int, v: np.ndarray) -> tuple:
        """(omega, alphas, betas, gamma) of free parameters; the variance of the whole is that of the series, 1."""
        if kind == "egarch":
            b = cap * sig(v[0])
            return float(v[2]) * 0.1, [float(v[1])], [b], float(v[3])
        total, share = cap * sig(v[0]), sig(v[1])
        split = lambda whole, n, at: [whole] if n == 1 else [whole * sig(v[at]), whole * (1 - sig(v[at]))]
        at = 2
        g = 0.0
        a = total * share
        if kind == "gjr":
            g = 2 * a * sig(v[at])
            a, at = a - g / 2, at + 1
        alphas = split(a, p, at)
        return 1 - total, alphas, split(total * (1 - share), q, at + (p > 1)), g

    def loss(h: np.ndarray, df: float) -> float:
        if df <= 0:
            return 0.5 * float(np.sum(np.log(2 * math.pi * h) + z * z / h))
        c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi * (df - 2))
        return float(np.sum(0.5 * np.log(h) + (df + 1) / 2 * np.log1p(z * z / (h * (df - 2))))) - len(z) * c

    best, free = flat, {}
    for kind, p, q in forms:
        start = [2.0, 0.1, 0.0, 0.0] if kind == "egarch" else [1.5, -1.5] + ([-1.0] if kind == "gjr" else []) + [1.0] * ((p > 1) + (q > 1))
        v = mathx.nelder_mead(lambda v, f=(kind, p, q): loss(garch_variance(z, *unpack(*f, v), f[0]), 0.0), start, most=60 * len(start))
        h = garch_variance(z, *unpack(kind, p, q, v), kind)
        # heavy tails: the degrees of freedom that fit the standardised shocks best
        df = min((loss(h, d), d) for d in (2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 30.0))[1]
        for errors, d in (("normal", 0.0), ("student", df)):
            aic = 2 * loss(h, d) + 2 * (len(v) + (d > 0))
            if aic < best["aic"]:
                o, a, b, g = unpack(kind, p, q, v)
                scale = var if kind != "egarch" else 1.0
                o = o * scale if kind != "egarch" else o + (1 - b[0]) * math.log(var)
                best = {"kind": kind, "errors": errors, "omega": o, "alpha": sum(a), "beta": sum(b), "gamma": g, "df": d, "aic": aic, "persistence": b[0] if kind == "egarch" else sum(a) + sum(b) + g / 2, "alphas": a, "betas": b}
    return best


def fitted_variance(e: np.ndarray, g: dict) -> np.ndarray:
    """The conditional variances of a fit of `garch_fit`."""
    if g["kind"] == "constant":
        return np.full(len(e), max(g["omega"], 1e-12))
    return garch_variance(e, g["omega"], g["alphas"], g["betas"], g["gamma"], g["kind"])


def ljung_box(e: np.ndarray, lags: int = 10) -> tuple[float, float]:
    e = e - e.mean()
    n, d = len(e), float((e * e).sum())
    if n <= lags + 1 or d <= 0:
        return 0.0, 1.0
    q = n * (n + 2) * sum((float((e[k:] * e[:-k]).sum()) / d) ** 2 / (n - k) for k in range(1, lags + 1))
    return q, mathx.chi2_sf(q, lags)


def arch_lm(e: np.ndarray, lags: int = 5) -> tuple[float, float]:
    s = e * e
    _, res = ar_fit(s, tuple(range(1, lags + 1)))
    tail = s[lags:]
    v = float(((tail - tail.mean()) ** 2).sum()) if len(tail) else 0.0
    stat = len(tail) * max(0.0, 1 - float((res**2).sum()) / v) if v > 0 and len(res) == len(tail) else 0.0
    return stat, mathx.chi2_sf(stat, lags)


def jarque_bera(e: np.ndarray) -> tuple[float, float]:
    e = e - e.mean()
    m2 = float((e**2).mean())
    if m2 <= 0:
        return 0.0, 1.0
    s, k = float((e**3).mean()) / m2**1.5, float((e**4).mean()) / m2**2 - 3
    jb = len(e) / 6 * (s * s + k * k / 4)
    return jb, mathx.chi2_sf(jb, 2)


def fit_marginal(x: np.ndarray) -> dict:
    """Normal, Student or empirical by AIC, with the distance of the chosen form; the empirical one if none is near."""
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if n < 10 or x[-1] - x[0] <= 0:
        return {"kind": "empirical", "loc": float(x.mean()) if n else 0.0, "scale": float(x.std()) if n else 0.0, "df": 0.0, "ks": 0.0, "p": 1.0}
    m, s = float(x.mean()), float(x.std())
    z = (x - m) / s
    normal = -2 * float(np.log(mathx.norm_pdf(z) / s).sum()) + 4
    kurt = float((z**4).mean()) - 3
    df = min(60.0, max(2.5, 4 + 6 / kurt)) if kurt > 0 else 60.0
    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    st = s * math.sqrt((df - 2) / df)
    student = -2 * float((c - math.log(st) - (df + 1) / 2 * np.log1p(((x - m) / st) ** 2 / df)).sum()) + 6
    kind = "normal" if normal <= student else "student"
    d = mathx.ks_statistic(x, mathx.norm_cdf(z) if kind == "normal" else mathx.t_cdf_all((x - m) / st, df))
    p = mathx.ks_pvalue(d, n)
    if p <= 0.05 and d >= 0.05:
        kind = "empirical"
    return {"kind": kind, "loc": m, "scale": s if kind != "student" else st, "df": df if kind == "student" else 0.0, "ks": d, "p": p}


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def fit_counts(x: np.ndarray) -> dict:
    """Poisson, negative binomial or zero-inflated negative binomial for counts, by AIC; zero: the share of extra zeros.

    Extra zeros must gain as much as BIC asks: the families are nested, and AIC would find some in one plain sample of six.
    """
    x = x[np.isfinite(x) & (x >= 0)].round()
    m, v = (float(x.mean()), float(x.var())) if len(x) else (0.0, 0.0)
    if m <= 0:
        return {"kind": "poisson", "mean": m, "size": 0.0, "zero": 0.0, "aic": 0.0}
    fits = [{"kind": "poisson", "mean": m, "size": 0.0, "zero": 0.0, "aic": -2 * float((x * math.log(m) - m - _lgamma(x + 1)).sum()) + 2}]

    def negative(mean: float, size: float) -> np.ndarray:
        return _lgamma(u + size) - math.lgamma(size) - _lgamma(u + 1) + size * math.log(size / (size + mean)) + u * math.log(mean / (size + mean))

    u, times = np.unique(x, return_counts=True)
    if v > m:
        size = mathx.nelder_mead(lambda q: -float((times * negative(m, math.exp(min(12.0, max(-12.0, q[0]))))).sum()), [math.log(m * m / (v - m))], most=80)
        r = math.exp(min(12.0, max(-12.0, float(size[0]))))
        fits.append({"kind": "negative_binomial", "mean": m, "size": r, "zero": 0.0, "aic": -2 * float((times * negative(m, r)).sum()) + 4})
    if v > m and u[0] == 0 and len(u) > 2:

        def loss(p: np.ndarray) -> float:
            q = np.clip(p, -12, 12)
            z = 1 / (1 + math.exp(-q[0]))
            like = math.log(1 - z) + negative(math.exp(q[1]), math.exp(q[2]))
            like[0] = math.log(z + (1 - z) * math.exp(min(0.0, like[0] - math.log(1 - z))))
            return -float((times * like).sum())

        p = np.clip(mathx.nelder_mead(loss, [-1.0, math.log(m), 0.5], most=250), -12, 12)
        fits.append({"kind": "zero_inflated", "mean": math.exp(p[1]), "size": math.exp(p[2]), "zero": 1 / (1 + math.exp(-p[0])), "aic": 2 * loss(p) + 6})
    return min(fits, key=lambda f: f["aic"] + (math.log(len(x)) - 2 if f["kind"] == "zero_inflated" else 0.0))


def fit_family(x: np.ndarray) -> dict:
    """(kind, params, aic) of the continuous family of least AIC: normal, lognormal, Pareto, Beta, or a mixture of two normals.

    Families that the range of the values rules out aren't tried: lognormal and Pareto need positive values, Beta values
    between 0 and 1. Fewer than ten values, or equal ones, have the kind 'point'.
    """
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if n < 10 or x[-1] - x[0] <= 0:
        return {"kind": "point", "params": [float(x[0]) if n else 0.0], "aic": 0.0}
    m, s = float(x.mean()), float(x.std())
    log_normal = lambda v, mean, sd: -0.5 * ((v - mean) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
    fits = [("normal", [m, s], float(log_normal(x, m, s).sum()))]
    if x[0] > 0:
        y = np.log(x)
        fits.append(("lognormal", [float(y.mean()), float(y.std())], float((log_normal(y, y.mean(), max(1e-9, y.std())) - y).sum())))
        shape = n / max(1e-9, float((y - y[0]).sum()))
        fits.append(("pareto", [float(x[0]), shape], float(n * math.log(shape) + n * shape * y[0] - (shape + 1) * y.sum())))
    if x[0] > 0 and x[-1] < 1 and s * s < m * (1 - m):
        k = m * (1 - m) / (s * s) - 1
        a, b = m * k, (1 - m) * k
        fits.append(("beta", [a, b], float(((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)).sum() + n * (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)))))
    # two normals by expectation and maximisation from the halves, no narrower than a hundredth of the whole
    w, mean, sd = np.array([0.5, 0.5]), np.array([x[: n // 2].mean(), x[n // 2 :].mean()]), np.array([s, s])
    for _ in range(200):
        like = np.log(w)[:, None] + np.stack([log_normal(x, mean[i], sd[i]) for i in (0, 1)])
        total = np.logaddexp(like[0], like[1])
        p = np.exp(like - total)
        w = np.maximum(p.sum(axis=1) / n, 1e-6)
        moved = (p @ x) / (w * n)
        sd = np.maximum(np.sqrt(np.stack([p[i] @ (x - moved[i]) ** 2 for i in (0, 1)]) / (w * n)), s / 100)
        still = np.abs(moved - mean).max() < 1e-7 * s
        mean = moved
        if still:
            break
    like = np.log(w)[:, None] + np.stack([log_normal(x, mean[i], sd[i]) for i in (0, 1)])
    fits.append(("mixture", [float(w[0]), *map(float, mean), *map(float, sd)], float(np.logaddexp(like[0], like[1]).sum())))
    kind, params, best = min(fits, key=lambda f: 2 * len(f[1]) - 2 * f[2])
    return {"kind": kind, "params": [float(v) for v in params], "aic": 2 * len(params) - 2 * best}


def shapiro_francia(x: np.ndarray) -> tuple[float, float]:
    """(W', p) of normality: squared correlation of the ordered values with normal scores, p by Royston's approximation."""
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if n < 5 or x[-1] - x[0] <= 0:
        return 1.0, 1.0
    scores = mathx.norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    w = float(np.corrcoef(x, scores)[0, 1] ** 2)
    u = math.log(n)
    v = math.log(u)
    mean, sd = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return w, float(1 - mathx.norm_cdf((math.log(max(1e-15, 1 - w)) - mean) / sd))


def partial_autocorrelations(x: np.ndarray, most: int) -> np.ndarray:
    """Partial autocorrelations at the lags 1 to most, by the recursion of Durbin and Levinson over the autocorrelations."""
    x = x - x.mean() if len(x) else x
    d = float(x @ x)
    if len(x) <= most + 1 or d <= 0:
        return np.zeros(most)
    r = np.array([float(x[k:] @ x[: len(x) - k]) / d for k in range(most + 1)])
    out, phi = np.zeros(most), np.zeros(0)
    for k in range(1, most + 1):
        rest = 1 - float(phi @ r[1:k]) if k > 1 else 1.0
        last = (r[k] - float(phi @ r[1:k][::-1])) / max(1e-12, rest)
        phi = np.append(phi - last * phi[::-1], last)
        out[k - 1] = last
    return out


def fit_lambda(x: np.ndarray, kind: str = "box_cox") -> float:
    """The exponent of a Box-Cox (values shifted above 0) or Yeo-Johnson transform of greatest normal likelihood, in [-3, 3]."""
    x = x[np.isfinite(x)]
    if len(x) < 5 or x.max() - x.min() <= 0:
        return 1.0
    if kind == "box_cox":
        y = x - min(0.0, float(x.min())) + 1e-6
        power = lambda v, k: np.log(v) if abs(k) < 1e-9 else (v**k - 1) / k
        turn, slope = (lambda k: power(y, k)), float(np.log(y).sum())
    else:
        pos = x >= 0
        up = lambda v, k: np.log1p(v) if abs(k) < 1e-9 else ((1 + v) ** k - 1) / k
        turn = lambda k: np.where(pos, up(np.abs(x), k), -up(np.abs(x), 2 - k))
        slope = float((np.sign(x) * np.log1p(np.abs(x))).sum())

    def loss(k: float) -> float:
        return len(x) / 2 * math.log(max(1e-300, float(turn(k).var()))) - (k - 1) * slope

    lo, hi, golden = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return (lo + hi) / 2


def decompose(t: np.ndarray, x: np.ndarray, changepoints: int = 5, day: int = 96, harmonics: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(trend, seasonal, residual, R²): a piecewise linear trend with Fourier terms of a day and a week, least squares.

    t: window index. Knots stand at equal steps, so a fit is a linear problem; this stands for a Bayesian trend model.
    """
    if len(x) < 20:
        m = float(x.mean()) if len(x) else 0.0
        return np.full(len(x), m), np.zeros(len(x)), x - m, 0.0
    u = (t - t[0]) / max(1, t[-1] - t[0])
    knots = np.linspace(0, 1, changepoints + 2)[1:-1]
    trend = np.column_stack([np.ones(len(x)), u, *(np.maximum(0, u - k) for k in knots)])
    waves = [f(2 * math.pi * h * t / p) for p in (day, 7 * day) for h in range(1, harmonics + 1) for f in (np.sin, np.cos)]
    season = np.column_stack(waves)
    a = np.column_stack([trend, season])
    beta = ols(a, x, ridge=1e-3)
    k = trend.shape[1]
    tr, se = trend @ beta[:k], season @ beta[k:]
    res = x - tr - se
    v = float(((x - x.mean()) ** 2).sum())
    return tr, se, res, 1 - float((res**2).sum()) / v if v > 0 else 0.0


def decay_fit(y: np.ndarray) -> dict:
    """Exponential or power decay of a response curve by log-linear least squares; power only if it gains 0.05 of R²."""
    k = np.arange(len(y), dtype=float)
    ok = y > 1e-9
    if ok.sum() < 3:
        return {"kind": "none", "amplitude": 0.0, "rate": 0.0, "r2": 0.0}

    def line(u: np.ndarray) -> tuple[float, float, float]:
        ly = np.log(y[ok])
        b = ols(np.column_stack([np.ones(ok.sum()), u[ok]]), ly)
        res = ly - b[0] - b[1] * u[ok]
        v = float(((ly - ly.mean()) ** 2).sum())
        return float(b[0]), float(b[1]), 1 - float((res**2).sum()) / v if v > 0 else 0.0

    e, p = line(k), line(np.log1p(k))
    kind, best = ("power", p) if p[2] > e[2] + 0.05 else ("exp", e)
    return {"kind": kind, "amplitude": math.exp(best[0]), "rate": -best[1], "r2": best[2]}


def nearest_correlation(c: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """A positive definite correlation matrix: negative eigenvalues raised, diagonal brought back to 1."""
    c = np.where(np.isfinite(c), c, 0.0)
    np.fill_diagonal(c, 1.0)
    w, v = np.linalg.eigh((c + c.T) / 2)
    m = v @ np.diag(np.maximum(w, floor)) @ v.T
    d = np.sqrt(np.diag(m))
    return m / np.outer(d, d)


def copula_sample(corr: np.ndarray, profiles: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Rows of a Gaussian copula with the given correlations and marginals (values at equal steps of rank)."""
    z = np.random.default_rng(seed).standard_normal((rows, len(corr))) @ np.linalg.cholesky(nearest_correlation(corr)).T
    u = mathx.norm_cdf(z) * (profiles.shape[1] - 1)
    lo = np.minimum(u.astype(int), profiles.shape[1] - 2)
    f = u - lo
    cols = np.arange(profiles.shape[0])
    return profiles[cols, lo] * (1 - f) + profiles[cols, lo + 1] * f


def block_bootstrap(h: np.ndarray, rows: int, seed: int, block: int = 96) -> np.ndarray:
    """Blocks of past volatility in random order, each scaled between 0.9 and 1.1; seeded."""
    rng = np.random.default_rng(seed)
    if not len(h):
        return np.zeros(rows)
    out = []
    while sum(map(len, out)) < rows:
        at = int(rng.integers(0, max(1, len(h) - block + 1)))
        out.append(h[at : at + block] * rng.uniform(0.9, 1.1))
    return np.concatenate(out)[:rows]


def per_series(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn over each series."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def forecast(t: np.ndarray, x: np.ndarray, feats: np.ndarray, lags: int = 12, train: float = 0.6) -> pd.DataFrame:
    """The default forecaster: ridge regression on lags and features, bands from training residuals.

    Gives what the signals need: true and median value, residual, divergence, and how the prediction's weight spreads
    over lags (attention) and features (vsn), both as probabilities. A neural model can take its place.
    """
    n = len(x)
    if n <= lags + 5:
        return pd.DataFrame(columns=["time_idx", "target_true", "p10", "p50", "p90", "residual", "divergence", "attention", "vsn"])
    hist = np.column_stack([x[lags - k : n - k] for k in range(1, lags + 1)])
    f = feats[lags:]
    a = np.column_stack([np.ones(n - lags), hist, f])
    y = x[lags:]
    cut = max(lags + 2, int(train * len(y)))
    beta = ols(a[:cut], y[:cut], ridge=1.0)
    p50 = a @ beta
    res = y - p50
    q10, q90 = np.percentile(res[:cut], [10, 90])
    att = np.abs(hist * beta[1 : lags + 1]) + 1e-10
    vsn = np.abs(f * beta[lags + 1 :]) + 1e-10
    width = max(1e-9, float(q90 - q10))
    return pd.DataFrame({"time_idx": t[lags:], "target_true": y, "p10": p50 + q10, "p50": p50, "p90": p50 + q90, "residual": res, "divergence": np.abs(res) / width, "attention": list(att / att.sum(axis=1, keepdims=True)), "vsn": list(vsn / vsn.sum(axis=1, keepdims=True))})


def infer(df: DataFrame, columns: list[str], load: Callable[[], Callable[..., Sequence]], schema: str, out: str, batch: int = 64) -> DataFrame:
    """df with a column `out` that a user's model gives, such as a sentiment or an embedding, in Arrow batches.

    load is called once for each Python worker and returns a function from lists of the columns' values, at most `batch`
    of each, to as many results. A row with a null in any of the columns has a null result and isn't passed on.
    """

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for series in batches:
            frame = pd.concat(series, axis=1)
            known = frame.notna().all(axis=1).to_numpy()
            values = [frame.iloc[:, k][known].tolist() for k in range(frame.shape[1])]
            found: list = []
            for at in range(0, int(known.sum()), batch):
                found += list(model(*(v[at : at + batch] for v in values)))
            result: list = [None] * len(frame)
            for i, v in zip(np.flatnonzero(known), found, strict=True):
                result[i] = v
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(*(F.col(c) for c in columns)))
