"""Queries of diagnostics, smoothing, decoding and counts that the other modules don't hold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.labels import plain_label, plain_label_sql
from tidemark.operators import diagnostics as dg
from tidemark.operators import windows as wn
from tidemark.plans.common import DETECTIONS, OFFICIAL, POSTS, WINDOWS, detections, official, posts, r, windows

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_SIG = ["static_signal_z_max", "collective_density", "collective_volatility"]
_SEP = f"{DETECTIONS}, x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS target, {c} AS v, {plain_label_sql('pred_label')} <> 'N' AS p FROM det WHERE pred_label IS NOT NULL AND {c} IS NOT NULL" for c in _SIG) + ")"


@query(f"WITH {_SEP}, m AS (SELECT target, avg(v) FILTER (NOT p) AS m0, avg(v) FILTER (p) AS m1, stddev_samp(v) FILTER (NOT p) AS s0, stddev_samp(v) FILTER (p) AS s1, count(*) FILTER (NOT p) AS n0, count(*) FILTER (p) AS n1 FROM x GROUP BY 1), k AS (SELECT target, p, rank() OVER (PARTITION BY target ORDER BY abs(v)) + (count(*) OVER (PARTITION BY target, abs(v)) - 1) / 2.0 AS r FROM x), u AS (SELECT target, sum(r) FILTER (p) AS s FROM k GROUP BY 1) SELECT target, round((m1 - m0) / (sqrt((s0 * s0 + s1 * s1) / 2) + 1e-10), 5) AS cohen_d, round((s - n1 * (n1 + 1) / 2.0) / (n0 * n1), 6) AS auc, n0 AS n_normal, n1 AS n_alarm FROM m JOIN u USING (target)")
def target_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """ML5."""
    from tidemark.operators.robust import melt

    det = detections(spark, d).where("pred_label IS NOT NULL").withColumn("p", plain_label(F.col("pred_label")) != "N")
    long = melt(det, ["p"], _SIG).withColumnRenamed("feature", "target")
    return dg.separation(long, ["target"], "p").select("target", r(F.col("cohen_d"), 5).alias("cohen_d"), r(F.col("auc")).alias("auc"), "n_normal", "n_alarm")


_HELD = f"{WINDOWS}, m AS (SELECT date_trunc('month', \"timestamp\") AS month, max(\"timestamp\") AS last FROM w19 GROUP BY 1), h AS (SELECT CAST(w.total_volume_comment AS DOUBLE) AS x, w.\"timestamp\" > m.last - INTERVAL 4 DAY AS held FROM w19 w JOIN m ON date_trunc('month', w.\"timestamp\") = m.month WHERE w.total_volume_comment IS NOT NULL), p AS (SELECT x, CASE WHEN held THEN 'held' ELSE 'train' END AS part FROM h UNION ALL SELECT x, 'full' FROM h), q AS (SELECT part, median(x) AS med FROM p GROUP BY 1), s AS (SELECT p.part, 1.4826 * median(abs(x - med)) AS s FROM p JOIN q USING (part) GROUP BY 1)"


@query(f"WITH {_HELD} SELECT round(max(s) FILTER (part = 'train'), 6) AS train_scale, round(max(s) FILTER (part = 'held'), 6) AS held_scale, round(max(s) FILTER (part = 'full'), 6) AS full_scale, round(max(s) FILTER (part = 'held') / nullif(max(s) FILTER (part = 'train'), 0), 6) AS inflation FROM s")
def baseline_bias(spark: SparkSession, d: str) -> DataFrame:
    """ML9."""
    w = windows(spark, d).withColumn("month", F.date_trunc("month", "timestamp"))
    m = w.groupBy("month").agg(F.max("timestamp").alias("last"))
    h = w.join(m, "month").withColumn("held", F.col("timestamp") > F.col("last") - F.expr("INTERVAL 4 DAYS")).withColumn("k", F.lit(0)).withColumn("x", F.col("total_volume_comment").cast("double"))
    return dg.baseline_bias(h, ["k"], "x", "held").select(*(r(F.col(c)).alias(c) for c in ("train_scale", "held_scale", "full_scale", "inflation")))


_ATT = ["gini_post", "comp_ratio_post", "neg_ratio_post", "semantic_shift_post"]
_P = "list_transform(a, lambda x: (abs(x) + 1e-10) / list_sum(list_transform(a, lambda y: abs(y) + 1e-10)))"
_JS = "list_sum(list_transform(list_zip({p}, {q}), lambda z: 0.5 * z[1] * ln(2 * z[1] / (z[1] + z[2])) + 0.5 * z[2] * ln(2 * z[2] / (z[1] + z[2]))))"


@query(f"WITH {WINDOWS}, x AS (SELECT official_uid, window_id, [{', '.join(f'coalesce({c}, 0.0)' for c in _ATT)}] AS a FROM w19), p AS (SELECT official_uid, window_id, {_P} AS p FROM x), b AS (SELECT *, lag(p) OVER (PARTITION BY official_uid ORDER BY window_id) AS q, [0.25, 0.25, 0.25, 0.25] AS e FROM p) SELECT window_id, round(-list_sum(list_transform(p, lambda z: z * ln(z))), 5) AS entropy, round(sqrt(greatest({_JS.format(p='p', q='e')}, 0)), 5) AS distance_to_even, CASE WHEN q IS NOT NULL THEN round(sqrt(greatest({_JS.format(p='p', q='q')}, 0)), 5) END AS change FROM b")
def attention_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """SF36: entropy, distance to even weights, distance to the window before."""
    a = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in _ATT))
    x = windows(spark, d).select("official_uid", "window_id", a.alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("official_uid").orderBy("window_id")))
    spread = dg.attention_spread(F.col("a"))
    return x.select("window_id", *(r(c, 5).alias(n) for n, c in spread.items()), r(dg.temporal_distance(F.col("a"), F.col("b")), 5).alias("change"))


_G = [(k, math.exp(-0.5 * (k / (12 / 3)) ** 2)) for k in range(-6, 7)]


@query(f"WITH {WINDOWS}, s AS (SELECT official_uid, window_id, CAST(total_volume_comment AS DOUBLE) AS x FROM w19), l AS (SELECT *, " + ", ".join(f"lead(x, {k}) OVER w AS v{k + 6}" for k, _ in _G) + ", avg(x * x) OVER q AS sq, count(x) OVER q AS n FROM s WINDOW w AS (PARTITION BY official_uid ORDER BY window_id), q AS (PARTITION BY official_uid ORDER BY window_id ROWS 23 PRECEDING)) SELECT window_id, round((" + " + ".join(f"coalesce(v{k + 6} * {g!r}, 0)" for k, g in _G) + ") / nullif(" + " + ".join(f"CASE WHEN v{k + 6} IS NOT NULL THEN {g!r} ELSE 0 END" for k, g in _G) + ", 0), 5) AS smooth, CASE WHEN n >= 24 THEN round(sq + 1e-9, 5) END AS mean_square FROM l")
def smoothing(spark: SparkSession, d: str) -> DataFrame:
    """WN12, WN13."""
    s = windows(spark, d).select("official_uid", "window_id", F.col("total_volume_comment").cast("double").alias("x"))
    q = wn.rows_back(["official_uid"], ["window_id"], 24)
    sq = F.col("x") * F.col("x")
    return s.select("window_id", r(dg.gaussian_mean("x", ["official_uid"], "window_id", 12), 5).alias("smooth"), r(wn.rolling(F.avg, sq, q, 24) + 1e-9, 5).alias("mean_square"))


@query(f"WITH {OFFICIAL} SELECT official_author || '_' || category AS combo, CAST(floor((epoch(ts) + 450) / 900) AS BIGINT) AS slot, count(*) AS n FROM official WHERE ts IS NOT NULL AND official_author IS NOT NULL AND category IS NOT NULL GROUP BY ALL")
def combo_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG34."""
    o = official(spark, d).where("ts IS NOT NULL AND official_author IS NOT NULL AND category IS NOT NULL")
    return o.groupBy(F.concat_ws("_", "official_author", "category").alias("combo"), (wn.nearest_slot(F.col("ts")) / 900).cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POSTS}, i AS (SELECT post_id, len(list_filter(string_split(coalesce(image_urls, ''), ', '), lambda u: u <> '')) AS n FROM posts) SELECT post_id, CAST(n > 0 AS INT) AS has_img, CAST(n AS BIGINT) AS img_count FROM i")
def image_columns(spark: SparkSession, d: str) -> DataFrame:
    """SF40."""
    n = F.size(F.filter(F.split(F.coalesce("image_urls", F.lit("")), ", "), lambda u: u != ""))
    return posts(spark, d).select("post_id", (n > 0).cast("int").alias("has_img"), n.cast("bigint").alias("img_count"))


@query("SELECT * FROM (VALUES ('model_comment_pc1_vsn_1', 'gini_comment'), ('model_comment_pc1_vsn_9', 'Unknown_VSN_model_comment_pc1_9'), ('model_x_att_24', 'Attention_model_x(t-24)'), ('model_x_att_val_0', 'Attention_model_x_Top0'), ('model_x_residual', 'Residual_model_x'), ('model_x_divergence', 'Divergence_model_x'), ('total_volume_post', 'total_volume_post')) AS t(name, decoded)")
def feature_names(spark: SparkSession, d: str) -> DataFrame:
    """SF37, PF19: names that detection generates, decoded."""
    names = ["model_comment_pc1_vsn_1", "model_comment_pc1_vsn_9", "model_x_att_24", "model_x_att_val_0", "model_x_residual", "model_x_divergence", "total_volume_post"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return df.select("name", dg.decode_feature(F.col("name"), {"model_comment_pc1": ["total_volume_comment", "gini_comment"]}).alias("decoded"))


@query()
def sparse_counts(spark: SparkSession, d: str) -> DataFrame:
    """ML34, ML40: seeded Poisson counts of sparse features with an event boost, and planted bursts, for tests of detection."""
    from tidemark.plans.statistics import _slots

    ev, vol = _slots(spark, d)
    boost = ev.groupBy("slot").agg(F.count(F.lit(1)).alias("k"))
    base = vol.join(boost, "slot", "left").withColumn("rate", 0.3 * F.coalesce("k", F.lit(0)) + F.log1p("x") / 4)

    def draw(it):
        for pdf in it:
            out = pdf[["slot"]].copy()
            out["n"] = [int(np.random.default_rng(int(s)).poisson(min(50.0, float(v)))) for s, v in zip(pdf["slot"], pdf["rate"])]
            out["planted"] = pdf["slot"] % 97 == 0
            out.loc[out["planted"], "n"] += 20
            yield out

    return base.select("slot", "rate").mapInPandas(draw, "slot bigint, n bigint, planted boolean")


QUERIES, ORACLES = Q, O
