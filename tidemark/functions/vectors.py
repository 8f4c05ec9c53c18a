"""Functions of ARRAY<DOUBLE> columns, all built from higher-order functions and so inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def probability(v: Column, eps: float = EPS) -> Column:
    """|v| + eps, scaled to sum 1."""
    return F.transform(F.array(F.transform(v, lambda x: F.abs(x.cast("double")) + eps)), lambda w: F.transform(w, lambda x: x / _sum(w)))[0]


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in nats of two probability vectors."""
    return _sum(F.zip_with(p, q, lambda x, y: x * F.ln(x / y)))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats."""
    return _sum(F.zip_with(p, q, lambda x, y: 0.5 * x * F.ln(2 * x / (x + y)) + 0.5 * y * F.ln(2 * y / (x + y))))


def ordinal_ranks(v: Column) -> Column:
    """Ranks from 0 by descending value, ties by position."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(v, lambda x, i: (F.array_position(F.transform(order, lambda s: s["i"]), i) - 1).cast("double"))


def spearman_distance(a: Column, b: Column) -> Column:
    """1 - rank correlation of ordinal ranks; 1 where it isn't defined."""
    n = F.size(a).cast("double")
    d2 = _sum(F.zip_with(ordinal_ranks(a), ordinal_ranks(b), lambda x, y: (x - y) * (x - y)))
    return F.coalesce(F.try_divide(6.0 * d2, n * (n * n - 1)), F.lit(1.0))


def entropy(p: Column) -> Column:
    return -_sum(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def hamming_hex(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two hexadecimal strings, 64 bits at a time."""
    out = F.lit(0)
    for k in range(0, digits, 16):
        x, y = (F.conv(F.substring(c, k + 1, 16), 16, -10).cast("bigint") for c in (a, b))
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out
