"""Robust scales, profiles, correlations and shape statistics of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.transforms import clip
from tidemark.session import materialize

MAD = 1.4826


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value DOUBLE): one row for each column, nulls and NaN left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))


#: Values of one key from which its exact percentiles are taken from counts of buckets instead of one group; buckets of a key.
LARGE, BUCKETS = 1_000_000, 1_000


def exact_percentiles(long: DataFrame, keys: list[str], x: str, points: list[float], large: int = LARGE, buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, q ARRAY<DOUBLE>): the exact percentiles, linear between neighbours, of each key's values that aren't null.

    A key of few values is one group. Of a large one, about equal buckets are cut at approximate quantiles (a sketch with
    map-side combine), counted, and only the buckets that hold a wanted rank, a few thousandths of the values each, are
    put in order: exact, and no task holds a key's values. Both ways give the same numbers.
    """
    d = long.select(*keys, F.col(x).cast("double").alias("x_")).where(F.col("x_").isNotNull())
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x_", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts_")) if keys else d.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x_", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts_"))
    sizes = materialize(sizes.withColumn("cuts_", F.array_distinct("cuts_")), "sizes")
    on = lambda a, b: a.join(b, keys) if keys else a.join(b)
    plain = on(d, sizes.where(F.col("n") < large).select(*keys, "n")).groupBy(*keys, "n").agg(F.percentile("x_", points).alias("q"))
    if not sizes.where(F.col("n") >= large).limit(1).count():
        return plain.select(*keys, "n", "q")
    big = sizes.where(F.col("n") >= large)
    # the bucket of a value: how many cuts lie below it, by halving
    at = F.col("cuts_")
    lo, hi = F.lit(0), F.size(at)
    b = on(d, big)
    b = b.withColumns({"lo_": lo, "hi_": hi})
    for _ in range(buckets.bit_length()):
        mid = F.floor((F.col("lo_") + F.col("hi_")) / 2).cast("int")
        below = (F.col("lo_") < F.col("hi_")) & (F.get(at, mid) < F.col("x_"))
        b = b.select(*keys, "n", "cuts_", "x_", F.when(below, mid + 1).otherwise(F.col("lo_")).alias("lo_"), F.when((F.col("lo_") < F.col("hi_")) & ~below, mid).otherwise(F.col("hi_")).alias("hi_"))
    b = materialize(b.select(*keys, "n", "x_", F.col("lo_").alias("b_")), "buckets")
    counts = b.groupBy(*keys, "n", "b_").agg(F.count(F.lit(1)).alias("m_"))  # `buckets` rows for each key
    before = counts.withColumn("from_", F.coalesce(F.sum("m_").over(Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))) for p in points))))
    wanted = before.select(*keys, "b_", "from_", F.filter(ranks, lambda k: (k >= F.col("from_")) & (k < F.col("from_") + F.col("m_"))).alias("ranks_")).where(F.size("ranks_") > 0)
    rows = b.join(wanted, [*keys, "b_"]).withColumn("k_", F.col("from_") + F.row_number().over(Window.partitionBy(*keys, "b_").orderBy("x_")) - 1)
    values = rows.where(F.array_contains("ranks_", F.col("k_").cast("bigint"))).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("k_", "x_"))).alias("v_"))  # two values for each point
    at_rank = lambda p: F.element_at("v_", F.floor(p * (F.col("n") - 1)).cast("bigint")) + (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))) * (F.element_at("v_", F.ceil(p * (F.col("n") - 1)).cast("bigint")) - F.element_at("v_", F.floor(p * (F.col("n") - 1)).cast("bigint")))
    return plain.select(*keys, "n", "q").unionByName(values.select(*keys, "n", F.array(*map(at_rank, points)).alias("q")))


def robust_scale(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median, scale, p5, p95): scale is 1.4826 MAD, or where the median is about zero the largest of P90, half the deviation and 1e-6.

    Two aggregations: the medians, then the deviations from them.
    """
    q = exact_percentiles(long, keys, "value", [0.5, 0.9, 0.05, 0.95]).select(*keys, *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p90_", "p5", "p95"))))
    first = materialize(q, "quantiles").join(long.groupBy(*keys).agg(F.stddev_pop("value").alias("sd_")), keys)
    away = long.join(first.select(*keys, "median"), keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("away_"))
    dev = exact_percentiles(away, keys, "away_", [0.5]).select(*keys, F.col("q")[0].alias("mad_"))
    flat = F.greatest(F.col("p90_"), 0.5 * F.col("sd_"), F.lit(1e-6))
    scale = F.when(F.abs("median") < 1e-10, flat).otherwise(F.greatest(MAD * F.col("mad_"), F.lit(1e-6)))
    return first.join(dev, keys).select(*keys, "median", scale.alias("scale"), "p5", "p95")


def robust_z(long: DataFrame, params: DataFrame, keys: list[str], limit: float = 5.0) -> DataFrame:
    """long with z, clipped."""
    return long.join(params.select(*keys, "median", "scale"), keys).withColumn("z", clip((F.col("value") - F.col("median")) / F.col("scale"), -limit, limit))


def percentile_profile(long: DataFrame, keys: list[str], points: int = 101) -> DataFrame:
    """(keys, n, mean, std, lowest, highest, zero_ratio, profile ARRAY<DOUBLE>)."""
    grid = [i / (points - 1) for i in range(points)]
    q = exact_percentiles(long, keys, "value", grid).select(*keys, F.col("q").alias("profile"))
    return long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("zero_ratio")).join(q, keys)


def moments(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, std, skew, kurtosis): population skewness and excess kurtosis."""
    return long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))
    return one.select(F.inline(rows))


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b of two columns from their table of joint counts: pairs of distinct values, not pairs of rows.

    The joint table is compared with itself; its size is bounded by the distinct values, so bin continuous columns first.
    """
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    other = joint.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    s = joint.join(other, F.col("x") < F.col("x2")).agg(F.sum(F.col("n") * F.col("n2") * F.signum(F.col("y2") - F.col("y"))).alias("s"))
    total = joint.agg(F.sum("n").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).alias("n0"))
    ties = lambda c, out: joint.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(out))
    one = s.join(total).join(ties("x", "tx")).join(ties("y", "ty"))  # one row each
    return one.select((F.col("s") / F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))).alias("tau"))


def average_rank_percentile(x: str, partition: list[str]) -> Column:
    """(mean rank of equal values - 1) / (n - 1) * 100."""
    w = Window.partitionBy(*partition)
    rank = F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, x)) - 1) / 2
    return (rank - 1) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0)) * 100


def autocorrelations(df: DataFrame, partition: list[str], order: str, x: str, lags: list[int]) -> DataFrame:
    """(partition, lag, pearson, biased): correlation with the shifted series, and the estimate over the whole variance."""
    w = Window.partitionBy(*partition).orderBy(order)
    m = F.avg(x).over(Window.partitionBy(*partition))
    cols = df.select(*partition, order, F.col(x).cast("double").alias("x_"), (F.col(x) - m).alias("c_"), *(F.lag(F.col(x).cast("double"), k).over(w).alias(f"l{k}_") for k in lags))
    cols = cols.withColumns({f"c{k}_": F.lag("c_", k).over(w) for k in lags})
    stats = cols.groupBy(*partition).agg(*(F.corr("x_", f"l{k}_").alias(f"p{k}") for k in lags), *((F.sum(F.col("c_") * F.col(f"c{k}_")) / F.nullif(F.sum(F.col("c_") * F.col("c_")), F.lit(0.0))).alias(f"b{k}") for k in lags))
    return stats.select(*partition, F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("pearson"), F.col(f"b{k}").alias("biased")) for k in lags))))


def transform_choice(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skew, method, new_skew): standardize where |skew| <= 1, else the transform that lowers |skew| most."""
    from tidemark.functions.transforms import safe_log1p, safe_logit, safe_sqrt, yeo_johnson

    v = F.col("value")
    share = F.min(v) >= 0
    cands = {"sqrt": safe_sqrt(v), "log1p": safe_log1p(v), "logit": safe_logit(v), "yeo_johnson": yeo_johnson(v, 0.0)}
    s = long.groupBy(*keys).agg(F.skewness(v).alias("skew"), share.alias("positive_"), (F.max(v) <= 1).alias("unit_"), *(F.skewness(e).alias(f"s_{n}") for n, e in cands.items()))
    ok = {"sqrt": F.col("positive_"), "log1p": F.col("positive_"), "logit": F.col("positive_") & F.col("unit_"), "yeo_johnson": F.lit(True)}
    options = F.array_compact(F.array(*(F.when(ok[n] & F.col(f"s_{n}").isNotNull() & ~F.isnan(f"s_{n}"), F.struct(F.abs(f"s_{n}").alias("a"), F.lit(n).alias("m"), F.col(f"s_{n}").alias("s"))) for n in cands)))
    best = F.array_min(options)
    keep = (F.abs("skew") <= 1) | best.isNull() | (best["a"] >= F.abs("skew"))
    return s.select(*keys, "skew", F.when(keep, "standardize").otherwise(best["m"]).alias("method"), F.when(keep, F.col("skew")).otherwise(best["s"]).alias("new_skew"))


def wasserstein(a: DataFrame, b: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, distance, ks): area and greatest distance between the two distribution functions, over the merged values in order."""
    both = a.select(*keys, x, F.lit(1.0).alias("wa"), F.lit(0.0).alias("wb")).unionByName(b.select(*keys, x, F.lit(0.0).alias("wa"), F.lit(1.0).alias("wb"))).where(F.col(x).isNotNull())
    at = both.groupBy(*keys, x).agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    w, whole = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.lead(x).over(w) - F.col(x)
    apart = F.abs(F.sum("wa").over(run) / F.sum("wa").over(whole) - F.sum("wb").over(run) / F.sum("wb").over(whole))
    return at.select(*keys, apart.alias("a_"), (apart * gap).alias("d_")).groupBy(*keys).agg(F.sum("d_").alias("distance"), F.max("a_").alias("ks"))


def spikes(df: DataFrame, partition: list[str], x: str, k: float = 10.0) -> DataFrame:
    """df with is_spike: outside the 1 % and 99 % quantiles by k times their span."""
    q = exact_percentiles(df, partition, x, [0.01, 0.99]).select(*partition, F.col("q")[0].alias("q1_"), F.col("q")[1].alias("q9_"))
    span = F.col("q9_") - F.col("q1_")
    return df.join(q, partition, "left").withColumn("is_spike", F.coalesce((F.col(x) < F.col("q1_") - k * span) | (F.col(x) > F.col("q9_") + k * span), F.lit(False))).drop("q1_", "q9_")


def fix_runs(df: DataFrame, partition: list[str], order: str, x: str, bad: str) -> DataFrame:
    """df with fixed: runs of bad rows on a line between their good neighbours; a run at an end takes its one neighbour."""
    w = Window.partitionBy(*partition).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    good = F.when(~F.col(bad), F.struct(F.row_number().over(w).alias("i"), F.col(x).cast("double").alias("v")))
    m = df.withColumn("i_", F.row_number().over(w)).withColumn("g_", good).withColumn("l_", F.last("g_", ignorenulls=True).over(back)).withColumn("r_", F.first("g_", ignorenulls=True).over(ahead))
    line = F.col("l_.v") + (F.col("r_.v") - F.col("l_.v")) * (F.col("i_") - F.col("l_.i")) / (F.col("r_.i") - F.col("l_.i"))
    return m.withColumn("fixed", F.when(~F.col(bad), F.col(x).cast("double")).otherwise(F.coalesce(line, F.col("l_.v"), F.col("r_.v")))).drop("i_", "g_", "l_", "r_")


def k_smallest_to_zero(df: DataFrame, partition: list[str], x: str, tie: str, k: Column) -> DataFrame:
    """df with zeroed: the k smallest values of each partition are 0."""
    w = Window.partitionBy(*partition).orderBy(x, tie)
    return df.withColumn("zeroed", F.when(F.row_number().over(w) <= k, 0.0).otherwise(F.col(x)))


def quantile_calibrate(df: DataFrame, partition: list[str], x: str, profile: Column) -> DataFrame:
    """df with calibrated: each value moved to the target's value at its own rank, linear between the profile's knots.

    profile: an array of target values at equal steps of rank, on every row.
    """
    p = average_rank_percentile(x, partition) / 100 * (F.size(profile) - 1)
    d = df.withColumn("p_", F.coalesce(p, F.lit(0.0)))
    lo = F.floor("p_").cast("int")
    hi = F.least(lo + 1, F.size(profile) - 1)
    a, b = F.get(profile, lo), F.get(profile, hi)
    return d.withColumn("calibrated", a + (b - a) * (F.col("p_") - lo)).drop("p_")
