"""The windowed features of posts and comments, fused into one aggregation for each level of grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import text as tx

# Priors and gates of the features.
NEGATIVE_BELOW, PRIOR_N, PRIOR_SHARE, DAMPING = 0.4, 15, 0.15, 15
GATE_USERS, GATE_ROWS = 5, 10


def gini(counts_by_user: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, gini, users, rows): inequality of activity over users, from one row for each key and user.

    Under five users and under ten rows together it is 0; a single user above that is a monopoly, 1. Ordering happens
    by how often a count occurs, not user by user, so a key with very many users is a short list of distinct counts.
    """
    by_count = counts_by_user.groupBy(*keys, n).agg(F.count(F.lit(1)).alias("m_"))
    w = Window.partitionBy(*keys).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    before = by_count.withColumn("b_", F.coalesce(F.sum("m_").over(w), F.lit(0)))
    # the ranks of m equal counts after b smaller ones sum to m*b + m*(m+1)/2
    g = before.groupBy(*keys).agg(F.sum(F.col(n) * (F.col("m_") * F.col("b_") + F.col("m_") * (F.col("m_") + 1) / 2)).alias("s_"), F.sum("m_").alias("users"), F.sum(F.col(n) * F.col("m_")).alias("rows"))
    value = 2 * F.col("s_") / (F.col("users") * F.col("rows")) - (F.col("users") + 1) / F.col("users")
    gate = (F.col("users") < GATE_USERS) & (F.col("rows") < GATE_ROWS)
    return g.select(*keys, F.when(gate, 0.0).when(F.col("users") == 1, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("gini"), "users", "rows")


def negative_ratio(score: Column) -> Column:
    """Share of negative scores, pulled to the prior; aggregate."""
    return (F.count_if(score < NEGATIVE_BELOW) + PRIOR_N * PRIOR_SHARE) / (F.count(F.lit(1)) + PRIOR_N)


def channel_features(df: DataFrame, keys: list[str], channel: Column, text: str, author: str, retweet: Column, channels: tuple[str, str] = ("post", "comment")) -> DataFrame:
    """One row for each key with the counted features of both channels: a single aggregation, one shuffle.

    Volumes count texts that aren't null; unique users count authors that aren't null.
    """
    t = F.col(text)
    aggs = []
    for c in channels:
        on = channel == c
        aggs += [
            F.count(F.when(on, t)).alias(f"total_volume_{c}"),
            F.count_distinct(F.when(on, F.col(author))).alias(f"unique_users_{c}"),
            F.coalesce(F.sum(F.when(on, tx.symbol_intensity(t))), F.lit(0)).cast("bigint").alias(f"senti_symbol_{c}"),
            F.count_if(on & (tx.length_class(t) == "Short")).alias(f"total_short_{c}"),
            F.count_if(on & (tx.length_class(t) == "Medium")).alias(f"total_medium_{c}"),
            F.count_if(on & (tx.length_class(t) == "Long")).alias(f"total_long_{c}"),
        ]
    post = channel == channels[0]
    aggs.append((F.count_if(post & retweet) / (F.count(F.when(post, t)) + DAMPING)).alias("retweet_ratio_post"))
    return df.groupBy(*keys).agg(*aggs)


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, centroid ARRAY<DOUBLE>): element-wise means, by partial aggregation over (key, position)."""
    flat = df.select(*keys, F.posexplode(vector).alias("i_", "x_"))
    means = flat.groupBy(*keys, "i_").agg(F.avg(F.col("x_").cast("double")).alias("m_"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "m_"))), lambda s: s["m_"]).alias("centroid"))
