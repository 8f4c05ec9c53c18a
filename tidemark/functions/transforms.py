"""Scalar transforms of features, with inverses. A null stays null unless stated; NaN counts as null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), None).otherwise(x)


def safe_log1p(x: Column) -> Column:
    return F.log1p(F.greatest(clean(x), F.lit(0.0)))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(clean(x), F.lit(0.0)))


def safe_logit(x: Column, eps: float = 1e-6) -> Column:
    """Log odds of a share kept within eps of 0 and 1; null counts as one half."""
    p = clip(F.coalesce(clean(x), F.lit(0.5)), eps, 1 - eps)
    return F.ln(p / (1 - p))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def yeo_johnson(x: Column, lam: float) -> Column:
    x = clean(x)
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.power(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.power(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    y = clean(y)
    up = F.expm1(y) if abs(lam) < 1e-12 else F.power(F.greatest(y * lam + 1, F.lit(1e-12)), F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if abs(lam - 2) < 1e-12 else 1 - F.power(F.greatest(1 - (2 - lam) * y, F.lit(1e-12)), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float, shift: float | Column = 0.0) -> Column:
    v = clean(x) - shift
    return F.ln(v) if abs(lam) < 1e-12 else (F.power(v, F.lit(lam)) - 1) / lam


def box_cox_inverse(y: Column, lam: float, shift: float | Column = 0.0) -> Column:
    return (F.exp(y) if abs(lam) < 1e-12 else F.power(F.greatest(y * lam + 1, F.lit(1e-12)), F.lit(1 / lam))) + shift


def standardize(x: Column, mean: Column, std: Column) -> Column:
    """With the population standard deviation; a deviation of 0 counts as 1."""
    return (x - mean) / F.when((std == 0) | std.isNull(), 1.0).otherwise(std)


def tanh_cap(x: Column, limit: float) -> Column:
    return limit * F.tanh(x / limit)


def exp_decay(t: Column, amplitude: float, tau: float) -> Column:
    return amplitude * F.exp(-t / tau)


def power_decay(t: Column, amplitude: float, gamma: float) -> Column:
    return amplitude * F.power(t + 1, F.lit(-gamma))


def apply_method(x: Column, method: Column, lam: Column, mean: Column, std: Column) -> Column:
    """A transform chosen row by row from a parameter table."""
    lam = F.coalesce(lam, F.lit(1.0))
    v = clean(x)
    up = F.when(F.abs(lam) < 1e-12, F.log1p(F.greatest(v, F.lit(0.0)))).otherwise((F.power(F.greatest(v, F.lit(0.0)) + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam))
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-12, -F.log1p(F.greatest(-v, F.lit(0.0)))).otherwise(-(F.power(1 + F.greatest(-v, F.lit(0.0)), two) - 1) / F.when(F.abs(two) < 1e-12, 1.0).otherwise(two))
    return (
        F.when(method == "sqrt", safe_sqrt(x))
        .when(method == "log1p", safe_log1p(x))
        .when(method == "logit", safe_logit(x))
        .when(method == "yeo_johnson", F.when(v >= 0, up).otherwise(down))
        .when(method == "standardize", standardize(v, mean, std))
        .otherwise(v)
    )
