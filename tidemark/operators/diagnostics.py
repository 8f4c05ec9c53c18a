"""How well targets tell alarms apart, how biased a baseline is, and how attention spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec


def separation(long: DataFrame, keys: list[str], positive: str) -> DataFrame:
    """(keys, cohen_d, auc, n_normal, n_alarm): value and its size against a flag.

    The area under the curve comes from rank sums over distinct values, so equal values share their ranks.
    """
    v, p = F.col("value"), F.col(positive)
    m = long.groupBy(*keys).agg(F.avg(F.when(~p, v)).alias("m0"), F.avg(F.when(p, v)).alias("m1"), F.stddev_samp(F.when(~p, v)).alias("s0"), F.stddev_samp(F.when(p, v)).alias("s1"), F.count_if(~p).alias("n_normal"), F.count_if(p).alias("n_alarm"))
    at = long.groupBy(*keys, F.abs(v).alias("a_")).agg(F.count_if(~p).alias("c0"), F.count_if(p).alias("c1"))
    before = Window.partitionBy(*keys).orderBy("a_").rowsBetween(Window.unboundedPreceding, -1)
    u = at.withColumn("u_", F.col("c1") * (F.coalesce(F.sum("c0").over(before), F.lit(0)) + F.col("c0") / 2)).groupBy(*keys).agg(F.sum("u_").alias("u"))
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 2) + 1e-10
    auc = F.coalesce(F.try_divide(F.col("u"), F.col("n_normal") * F.col("n_alarm")), F.lit(0.5))
    return m.join(u, keys).select(*keys, ((F.col("m1") - F.col("m0")) / pooled).alias("cohen_d"), auc.alias("auc"), "n_normal", "n_alarm")


def baseline_bias(df: DataFrame, keys: list[str], x: str, held: str) -> DataFrame:
    """(keys, train_scale, held_scale, full_scale, inflation): 1.4826 MAD of both parts and of all."""
    parts = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("x_"), F.explode(F.array(F.when(F.col(held), "held").otherwise("train"), F.lit("full"))).alias("part_"))
    med = parts.groupBy(*keys, "part_").agg(F.median("x_").alias("m_"))
    mad = parts.join(med, [*keys, "part_"]).groupBy(*keys, "part_").agg((1.4826 * F.median(F.abs(F.col("x_") - F.col("m_")))).alias("s_"))
    wide = mad.groupBy(*keys).pivot("part_", ["train", "held", "full"]).agg(F.first("s_"))
    return wide.select(*keys, F.col("train").alias("train_scale"), F.col("held").alias("held_scale"), F.col("full").alias("full_scale"), F.try_divide(F.col("held"), F.col("train")).alias("inflation"))


def attention_spread(attention: Column) -> dict[str, Column]:
    """Entropy of a weight vector, and its distance (root of the divergence) to even weights."""
    p = vec.probability(attention)
    even = F.transform(attention, lambda x: F.lit(1.0) / F.size(attention))
    return {"entropy": vec.entropy(p), "distance_to_even": F.sqrt(F.greatest(vec.js(p, even), F.lit(0.0)))}


def temporal_distance(attention: Column, before: Column) -> Column:
    """Distance of a weight vector to the one before; null for the first."""
    return F.when(before.isNotNull(), F.sqrt(F.greatest(vec.js(vec.probability(attention), vec.probability(before)), F.lit(0.0))))


def gaussian_mean(x: str, partition: list[str], order: str, window: int) -> Column:
    """Centred mean with normal weights of a third of the window; edges use what is there."""
    half = window // 2
    w = Window.partitionBy(*partition).orderBy(order)
    sd = window / 3
    num, den = F.lit(0.0), F.lit(0.0)
    for k in range(-half, half + 1):
        v = F.lag(x, -k).over(w) if k else F.col(x)
        g = math.exp(-0.5 * (k / sd) ** 2)
        num = num + F.coalesce(v * g, F.lit(0.0))
        den = den + F.when(v.isNotNull(), g).otherwise(0.0)
    return F.try_divide(num, den)


def decode_feature(name: Column, models: dict[str, list[str]]) -> Column:
    """A readable name of a generated feature: variables by index, attention by lag, scalars by kind; others unchanged."""
    table = F.create_map(*(F.lit(v) for m, names in models.items() for v in (m, F.array(*map(F.lit, names)))))
    model, index = F.regexp_extract(name, r"^(.*?)_vsn_(\d+)", 1), F.regexp_extract(name, r"^(.*?)_vsn_(\d+)", 2).try_cast("int")
    found = F.get(F.try_element_at(table, model), index)
    lag = r"^(.*?)_att_(\d+)"
    return (
        F.when(name.rlike(r"_vsn_\d+"), F.coalesce(found, F.concat(F.lit("Unknown_VSN_"), model, F.lit("_"), index.cast("string"))))
        .when(name.rlike(r"_att_val_"), F.concat(F.lit("Attention_"), F.split(name, "_att_")[0], F.lit("_Top"), F.regexp_extract(name, r"_att_val_(.*)$", 1)))
        .when(name.rlike(r"_att_\d+"), F.concat(F.lit("Attention_"), F.regexp_extract(name, lag, 1), F.lit("(t-"), F.regexp_extract(name, lag, 2), F.lit(")")))
        .when(name.contains("_resid"), F.concat(F.lit("Residual_"), F.split(name, "_resid")[0]))
        .when(name.contains("_div"), F.concat(F.lit("Divergence_"), F.split(name, "_div")[0]))
        .otherwise(name)
    )
