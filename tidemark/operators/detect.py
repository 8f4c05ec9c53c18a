"""Deviation signals and the layered detection of point anomalies, collective anomalies and drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.functions.transforms import clean, clip

SIGNALS = ("residual_ratio", "vsn_rank_shift", "att_kl", "vsn_js")


@dataclass(frozen=True)
class Thresholds:
    """Defaults are the published ones: windows of 15 minutes, three days and four weeks."""

    models: tuple[str, ...] = ("comment_pc1", "post_pc1")
    point_k: float = 5.0
    point_votes: int = 4
    roll: int = 8
    collective_k: float = 3.0
    volatility_factor: float = 1.5
    density: float = 0.95
    collective_rows: int = 288
    collective_least: int = 96
    drift_k: float = 2.0
    drift_rows: int = 2688
    drift_least: int = 288
    drift_lag: int = 1344
    rank_floor: float = 0.05
    kl_floor: float = 0.10
    relax: float = 1.0

    def point_columns(self) -> list[str]:
        return [f"model_{m}_{s}_rollmax_{self.roll}" for m in self.models for s in SIGNALS]

    def level_columns(self) -> dict[str, float]:
        """Signals of the collective level with the least standard deviation of each."""
        return {f"model_{m}_{s}": floor for m in self.models for s, floor in (("vsn_rank_shift", self.rank_floor), ("att_kl", self.kl_floor))}


def require(df: DataFrame, columns: list[str]) -> None:
    """Raise at plan time if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def deviation_signals(df: DataFrame, residual: Column, attention: Column, vsn: Column, p5: Column, p95: Column, std: Column, att_mean: Column, vsn_mean: Column, model: str) -> DataFrame:
    """df with the four signals of a model: residual against its usual range, and how far its weights moved."""
    scale = F.greatest(F.abs(p95), F.abs(p5), 1.645 * F.abs(std), F.lit(vec.EPS))
    p, q = vec.probability(attention), vec.probability(att_mean)
    v, w = vec.probability(vsn), vec.probability(vsn_mean)
    return df.withColumns(
        {
            f"{model}_residual_ratio": clip(F.abs(residual) / scale, 0.0, 20.0),
            f"{model}_att_kl": clip(vec.kl(p, q), 0.0, 20.0),
            f"{model}_vsn_js": clip(vec.js(v, w), 0.0, 5.0),
            f"{model}_vsn_rank_shift": clip(vec.spearman_distance(v, w), 0.0, 2.0),
        }
    )


def roll_signals(df: DataFrame, partition: list[str], order: str, signals: list[str], n: int = 8) -> DataFrame:
    """Rolling maxima over the last n rows, then null, NaN and infinite values to 0, in that order."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-(n - 1), 0)
    rolled = df.withColumns({f"{s}_rollmax_{n}": F.max(clean(F.col(s))).over(w) for s in signals})
    return rolled.withColumns({c: F.coalesce(clean(F.col(c)), F.lit(0.0)) for c in [*signals, *(f"{s}_rollmax_{n}" for s in signals)]})


def calibrate(quiet: DataFrame, partition: list[str], t: Thresholds) -> DataFrame:
    """One row of thresholds for each series, from its quiet period: two passes of aggregation."""
    level = t.level_columns()
    require(quiet, [*t.point_columns(), *level])
    stats = [(F.avg(c) + t.point_k * F.stddev_samp(c)).alias(f"point:{c}") for c in t.point_columns()]
    for c, floor in level.items():
        stats += [F.avg(c).alias(f"mean:{c}"), F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(floor)).alias(f"std:{c}")]
    first = quiet.groupBy(*partition).agg(*stats)
    z = quiet.join(first, partition).withColumn("z_", _z_max(t))
    second = z.groupBy(*partition).agg(F.avg("z_").alias("m_"), F.stddev_samp("z_").alias("s_"), F.count(F.lit(1)).alias("quiet_rows"))
    second = second.select(*partition, "quiet_rows", (F.col("m_") + t.collective_k * F.col("s_")).alias("level_thr"), (F.col("s_") * t.volatility_factor).alias("vol_thr"), (F.col("m_") + t.drift_k * F.col("s_")).alias("drift_thr"))
    return first.join(second, partition)


def _z_max(t: Thresholds) -> Column:
    zs = [(F.col(c) - F.col(f"`mean:{c}`")) / F.col(f"`std:{c}`") for c in t.level_columns()]
    return zs[0] if len(zs) == 1 else F.greatest(*zs)


def predict(df: DataFrame, params: DataFrame, partition: list[str], order: str, ts: str, t: Thresholds, relaxed: float | None = None) -> DataFrame:
    """df with the level, density, volatility, trend, votes, labels, attribution times and dominant parts.

    params has a row for each series. Precedence of labels: collective (CA), then point (PA), then N. Rolling values are
    null below their least number of rows, and a null condition doesn't hold. With `relaxed` there is also relaxed_label,
    the label with point thresholds that much higher, as a new baseline has it while it warms up.
    """
    require(df, [*t.point_columns(), *t.level_columns(), ts])
    keep = df.columns
    x = df.join(params, partition)
    x = x.withColumn("static_signal_z_max", _z_max(t))
    line = Window.partitionBy(*partition).orderBy(order)
    w3, w28 = line.rowsBetween(-(t.collective_rows - 1), 0), line.rowsBetween(-(t.drift_rows - 1), 0)
    z = F.col("static_signal_z_max")
    high = (z > F.col("level_thr")).cast("double")
    votes = {c: F.coalesce((F.col(c) > F.col(f"`point:{c}`") * t.relax).cast("int"), F.lit(0)) for c in t.point_columns()}
    x = x.withColumns(
        {
            "collective_density": F.when(F.count(z).over(w3) >= t.collective_least, F.avg(high).over(w3)),
            "collective_volatility": F.when(F.count(z).over(w3) >= t.collective_least, F.stddev_samp(z).over(w3)),
            "changepoint_trend_mean": F.when(F.count(z).over(w28) >= t.drift_least, F.avg(z).over(w28)),
            "votes_": F.array(*votes.values()),
            "lag3_": F.lag(ts, t.collective_rows).over(line),
            "lag14_": F.lag(ts, t.drift_lag).over(line),
        }
    )
    names = list(votes)
    ca = F.coalesce((F.col("collective_density") > t.density) & (F.col("collective_volatility") < F.col("vol_thr")), F.lit(False))
    count = F.aggregate("votes_", F.lit(0), lambda a, b: a + b)
    x = x.withColumns({"point_trigger_count": count, "ca_": ca, "is_changepoint": F.coalesce(F.col("changepoint_trend_mean") > F.col("drift_thr"), F.lit(False))})
    pa = (F.col("point_trigger_count") >= t.point_votes) & ~F.col("ca_")

    def dominant(parts: tuple[str, ...], has) -> Column:
        """The part with most votes; of equals the first."""
        sums = [sum((F.get("votes_", F.lit(i)) for i, n in enumerate(names) if has(p, n)), F.lit(0)) for p in parts]
        out = F.lit(parts[-1])
        best = F.greatest(*sums) if len(sums) > 1 else sums[0]
        for p, s in reversed(list(zip(parts, sums))):
            out = F.when(s == best, F.lit(p)).otherwise(out)
        return out

    active = F.array_join(F.filter(F.zip_with(F.array(*map(F.lit, names)), "votes_", lambda n, v: F.when(v == 1, n)), lambda n: n.isNotNull()), "|")
    x = x.withColumns(
        {
            "pred_label": F.when(F.col("ca_"), "CA").when(pa, "PA").otherwise("N"),
            "attribution_time": F.when(F.col("ca_"), F.col("lag3_")).when(pa, F.col(ts)),
            "changepoint_attribution_time": F.when(F.col("is_changepoint"), F.col("lag14_")),
            "dominant_model": F.when(pa, dominant(t.models, lambda p, n: f"model_{p}_" in n)).otherwise("N/A"),
            "dominant_signal": F.when(pa, dominant(SIGNALS, lambda p, n: f"_{p}_rollmax" in n)).otherwise("N/A"),
            "trigger_features": F.when(pa, active).otherwise(""),
        }
    )
    if relaxed is not None:
        fewer = sum((F.coalesce((F.col(c) > F.col(f"`point:{c}`") * relaxed).cast("int"), F.lit(0)) for c in t.point_columns()), F.lit(0))
        x = x.withColumn("relaxed_label", F.when(F.col("ca_"), "CA").when(fewer >= t.point_votes, "PA").otherwise("N"))
    new = [*(["relaxed_label"] if relaxed is not None else []), "static_signal_z_max", "collective_density", "collective_volatility", "changepoint_trend_mean", "is_changepoint", "point_trigger_count", "pred_label", "attribution_time", "changepoint_attribution_time", "dominant_model", "dominant_signal", "trigger_features"]
    return x.select(*[c for c in keep if c not in new], *new)
