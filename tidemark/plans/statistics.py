"""Queries of robust statistics, transforms, profiles, series and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import transforms as tr
from tidemark.operators import robust as rb
from tidemark.operators import windows as wn
from tidemark.plans.common import DETECTIONS, OFFICIAL, WINDOWS, detections, official, r, windows
from tidemark.sources.tables import table

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


COLS = ["total_volume_post", "gini_post", "comp_ratio_post", "neg_ratio_post", "semantic_shift_post", "retweet_ratio_post", "total_volume_comment", "gini_comment", "neg_ratio_comment", "semantic_shift_comment"]
_LONG = f"{WINDOWS}, long AS (" + " UNION ALL ".join(f"SELECT official_uid, window_id, \"timestamp\" AS ts, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM w19 WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in COLS) + ")"
_SCALE = "f1 AS (SELECT feature, median(value) AS med, quantile_cont(value, 0.9) AS p90, stddev_pop(value) AS sd, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM long GROUP BY 1), f2 AS (SELECT l.feature, median(abs(value - med)) AS mad FROM long l JOIN f1 USING (feature) GROUP BY 1), sc AS (SELECT f1.feature, med, p5, p95, CASE WHEN abs(med) < 1e-10 THEN greatest(p90, 0.5 * sd, 1e-6) ELSE greatest(1.4826 * mad, 1e-6) END AS scale FROM f1 JOIN f2 USING (feature))"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return rb.melt(windows(spark, d).withColumnRenamed("timestamp", "ts"), ["official_uid", "window_id", "ts"], COLS)


@query(f"WITH {_LONG}, {_SCALE} SELECT feature, round(med, 6) AS median, round(scale, 6) AS scale, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM sc")
def robust_scales(spark: SparkSession, d: str) -> DataFrame:
    """ML1, AG18."""
    return rb.robust_scale(_long(spark, d), ["feature"]).select("feature", *(r(F.col(c)).alias(c) for c in ("median", "scale", "p5", "p95")))


@query(f"WITH {_LONG}, {_SCALE} SELECT window_id, feature, round(least(greatest((value - med) / scale, -5.0), 5.0), 6) + 0.0 AS z FROM long JOIN sc USING (feature)")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    """ML2."""
    long = _long(spark, d)
    return rb.robust_z(long, rb.robust_scale(long, ["feature"]), ["feature"]).select("window_id", "feature", r(F.col("z")).alias("z"))


@query(f"WITH {_LONG}, {_SCALE}, e AS (SELECT window_id, avg(pow(least(greatest((value - med) / scale, -5.0), 5.0), 2)) AS energy FROM long JOIN sc USING (feature) GROUP BY 1), m AS (SELECT median(energy) AS med FROM e) SELECT round(m.med, 6) AS median, round((SELECT median(abs(energy - m.med)) FROM e), 6) AS mad, round((SELECT quantile_cont(energy, 0.95) FROM e), 6) AS p95 FROM m")
def quiet_energy(spark: SparkSession, d: str) -> DataFrame:
    """ML4."""
    long = _long(spark, d)
    e = rb.robust_z(long, rb.robust_scale(long, ["feature"]), ["feature"]).groupBy("window_id").agg(F.avg(F.col("z") * F.col("z")).alias("energy"))
    m = e.agg(F.median("energy").alias("m"), F.percentile("energy", 0.95).alias("p"))
    return e.join(m).groupBy("m", "p").agg(F.median(F.abs(F.col("energy") - F.col("m"))).alias("d")).select(r(F.col("m")).alias("median"), r(F.col("d")).alias("mad"), r(F.col("p")).alias("p95"))


@query(f"WITH {_LONG} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(CAST(value = 0 AS DOUBLE)), 6) AS zero_ratio, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM long GROUP BY 1")
def percentile_profile_101(spark: SparkSession, d: str) -> DataFrame:
    """AG20, AG33."""
    p = rb.percentile_profile(_long(spark, d), ["feature"])
    return p.select("feature", "n", *(r(F.col(c)).alias(c) for c in ("mean", "std", "lowest", "highest", "zero_ratio")), r(F.col("profile")[50]).alias("p50"), r(F.col("profile")[99]).alias("p99"))


@query(f"WITH {_LONG}, m AS (SELECT feature, avg(value) AS a, count(*) AS n FROM long GROUP BY 1), c AS (SELECT feature, a, sum(pow(value - a, 2)) / any_value(n) AS m2, sum(pow(value - a, 3)) / any_value(n) AS m3, sum(pow(value - a, 4)) / any_value(n) AS m4, any_value(n) AS n FROM long JOIN m USING (feature) GROUP BY feature, a) SELECT feature, round(a, 6) AS mean, round(sqrt(m2 * n / (n - 1)), 6) AS std, round(m3 / pow(m2, 1.5), 4) AS skew, round(m4 / (m2 * m2) - 3, 4) AS kurtosis FROM c")
def moments_population(spark: SparkSession, d: str) -> DataFrame:
    """AG31."""
    m = rb.moments(_long(spark, d), ["feature"])
    return m.select("feature", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("skew"), 4).alias("skew"), r(F.col("kurtosis"), 4).alias("kurtosis"))


_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query(f"WITH {WINDOWS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM w19" for a, b in _PAIRS))
def pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    """AG32."""
    return rb.correlations(windows(spark, d), COLS).select("a", "b", r(F.col("r")).alias("r"))


@query(f"WITH {WINDOWS}, j AS (SELECT total_volume_post AS x, total_volume_comment AS y, count(*) AS n FROM w19 WHERE total_volume_post IS NOT NULL AND total_volume_comment IS NOT NULL GROUP BY ALL), s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM j a JOIN j b ON a.x < b.x), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM j), tx AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM j GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM j GROUP BY y)) SELECT round(s / sqrt((n0 - tx.v) * (n0 - ty.v)), 6) AS tau FROM s, t, tx, ty")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    """AG32."""
    return rb.kendall_tau(windows(spark, d), "total_volume_post", "total_volume_comment").select(r(F.col("tau")).alias("tau"))


@query("SELECT event_id, round(ln(1 + greatest(value, 0)), 6) AS log1p, round(sqrt(greatest(value, 0)), 6) AS sqrt, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT *, least(greatest(coalesce(value / (1 + abs(value)), 0.5), 1e-6), 1 - 1e-6) AS p FROM events)")
def log1p_sqrt_logit(spark: SparkSession, d: str) -> DataFrame:
    """SF1, SF2, SF3, SF9."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r(tr.safe_log1p(v)).alias("log1p"), r(tr.safe_sqrt(v)).alias("sqrt"), r(tr.safe_logit(v / (1 + F.abs(v)))).alias("logit"))


@query("SELECT event_id, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 6) + 0.0 AS yj, round((pow(value + 1, 0.3) - 1) / 0.3, 6) AS bc, round(4.0 * tanh(x / 4.0), 6) + 0.0 AS capped FROM (SELECT *, value - 50 AS x FROM events)")
def yeo_johnson_boxcox(spark: SparkSession, d: str) -> DataFrame:
    """SF4, SF5, SF10."""
    x = F.col("value") - 50
    return table(spark, d, "events").select("event_id", r(tr.yeo_johnson(x, 0.5)).alias("yj"), r(tr.box_cox(F.col("value"), 0.3, F.lit(-1.0))).alias("bc"), r(tr.tanh_cap(x, 4.0)).alias("capped"))


@query("SELECT event_id, round(value - 50, 4) AS yj, round(value, 4) AS bc, round(value, 4) AS lg FROM events")
def inverse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SF6, SF7: inverse of the transform of a value is the value."""
    v = F.col("value")
    x = v - 50
    return table(spark, d, "events").select("event_id", r(tr.yeo_johnson_inverse(tr.yeo_johnson(x, 0.5), 0.5), 4).alias("yj"), r(tr.box_cox_inverse(tr.box_cox(v, 0.3, F.lit(-1.0)), 0.3, F.lit(-1.0)), 4).alias("bc"), r(F.expm1(tr.safe_log1p(v)), 4).alias("lg"))


@query()
def transform_choice(spark: SparkSession, d: str) -> DataFrame:
    """ML6."""
    c = rb.transform_choice(_long(spark, d), ["feature"])
    return c.select("feature", r(F.col("skew")).alias("skew"), "method", r(F.col("new_skew")).alias("new_skew"))


@query(f"WITH {_LONG}, k AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY 1) SELECT window_id, feature, round(CASE WHEN feature LIKE 'total%' THEN ln(1 + greatest(value, 0)) WHEN feature LIKE 'gini%' THEN sqrt(greatest(value, 0)) ELSE (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END END, 5) + 0.0 AS v FROM long JOIN k USING (feature)")
def transform_apply(spark: SparkSession, d: str) -> DataFrame:
    """ML7, SF8: a parameter table decides the transform of each feature."""
    long = _long(spark, d)
    method = F.when(F.col("feature").startswith("total"), "log1p").when(F.col("feature").startswith("gini"), "sqrt").otherwise("standardize")
    params = long.groupBy("feature").agg(F.avg("value").alias("mean_"), F.stddev_pop("value").alias("std_"))
    j = long.join(params, "feature")
    return j.select("window_id", "feature", r(tr.apply_method(F.col("value"), method, F.lit(None).cast("double"), F.col("mean_"), F.col("std_")), 5).alias("v"))


@query(f"WITH {DETECTIONS}, s AS (SELECT DISTINCT official_uid, time_idx, static_signal_z_max AS z FROM det) SELECT official_uid, time_idx, CASE WHEN count(z) OVER w >= 32 THEN round(avg(z) OVER w + 1e-9, 6) END AS mean96, CASE WHEN count(z) OVER w >= 32 THEN round(stddev_samp(z) OVER w, 5) END AS std96, round(max(z) OVER v, 6) AS max4, round(avg(z) OVER v + 1e-9, 6) AS mean4, round(z - lag(z) OVER o, 6) AS diff1, lag(time_idx, 12) OVER o AS lag12 FROM s WINDOW o AS (PARTITION BY official_uid ORDER BY time_idx), w AS (PARTITION BY official_uid ORDER BY time_idx ROWS 95 PRECEDING), v AS (PARTITION BY official_uid ORDER BY time_idx ROWS 3 PRECEDING)")
def rolling_gated(spark: SparkSession, d: str) -> DataFrame:
    """WN2 to WN7, WN10."""
    s = detections(spark, d).select("official_uid", "time_idx", F.col("static_signal_z_max").alias("z")).distinct()
    w, v = wn.rows_back(["official_uid"], ["time_idx"], 96), wn.rows_back(["official_uid"], ["time_idx"], 4)
    o = Window.partitionBy("official_uid").orderBy("time_idx")
    z = F.col("z")
    return s.select("official_uid", "time_idx", r(wn.rolling(F.avg, z, w, 32) + 1e-9).alias("mean96"), r(wn.rolling(F.stddev_samp, z, w, 32), 5).alias("std96"), r(F.max(z).over(v)).alias("max4"), r(F.avg(z).over(v) + 1e-9).alias("mean4"), r(z - F.lag(z).over(o)).alias("diff1"), F.lag("time_idx", 12).over(o).alias("lag12"))


@query(f"WITH {WINDOWS}, s AS (SELECT official_uid, window_id, \"timestamp\" AS ts, CAST(total_volume_comment AS DOUBLE) AS x, total_volume_comment - avg(total_volume_comment) OVER (PARTITION BY official_uid) AS c FROM w19), l AS (SELECT *, " + ", ".join(f"lag(x, {k}) OVER w AS x{k}, lag(c, {k}) OVER w AS c{k}" for k in (1, 4)) + " FROM s WINDOW w AS (PARTITION BY official_uid ORDER BY window_id)) " + " UNION ALL ".join(f"SELECT official_uid, {k} AS lag, round(CASE WHEN isnan(corr(x, x{k})) THEN NULL ELSE corr(x, x{k}) END, 5) AS pearson, round(sum(c * c{k}) / nullif(sum(c * c), 0), 6) AS biased FROM l GROUP BY 1" for k in (1, 4)))
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """WN17: both estimators."""
    a = rb.autocorrelations(windows(spark, d), ["official_uid"], "window_id", "total_volume_comment", [1, 4])
    return a.select("official_uid", "lag", r(tr.clean(F.col("pearson")), 5).alias("pearson"), r(F.col("biased")).alias("biased"))


@query(f"WITH {WINDOWS} SELECT window_id, round((rank() OVER (PARTITION BY official_uid ORDER BY neg_ratio_post) + (count(*) OVER (PARTITION BY official_uid, neg_ratio_post) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY official_uid) - 1, 0) * 100, 6) AS pct FROM w19 WHERE neg_ratio_post IS NOT NULL")
def avg_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """WN14."""
    return windows(spark, d).where("neg_ratio_post IS NOT NULL").select("window_id", r(rb.average_rank_percentile("neg_ratio_post", ["official_uid"])).alias("pct"))


@query(f"WITH {WINDOWS} SELECT window_id, CASE WHEN row_number() OVER (PARTITION BY official_uid ORDER BY neg_ratio_post, window_id) <= 0.1 * count(*) OVER (PARTITION BY official_uid) THEN 0.0 ELSE neg_ratio_post END AS zeroed FROM w19 WHERE neg_ratio_post IS NOT NULL")
def k_smallest_zero(spark: SparkSession, d: str) -> DataFrame:
    """WN16."""
    df = windows(spark, d).where("neg_ratio_post IS NOT NULL")
    return rb.k_smallest_to_zero(df, ["official_uid"], "neg_ratio_post", "window_id", 0.1 * F.count(F.lit(1)).over(Window.partitionBy("official_uid"))).select("window_id", "zeroed")


@query(f"WITH {WINDOWS}, x AS (SELECT window_id, official_uid, neg_ratio_comment AS v FROM w19 WHERE neg_ratio_comment IS NOT NULL), t AS (SELECT quantile_cont(neg_ratio_post, {[i / 100 for i in range(101)]}) AS q FROM w19 WHERE neg_ratio_post IS NOT NULL), p AS (SELECT window_id, coalesce((rank() OVER (PARTITION BY official_uid ORDER BY v) + (count(*) OVER (PARTITION BY official_uid, v) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY official_uid) - 1, 0) * 100, 0) AS p FROM x) SELECT window_id, round(q[CAST(floor(p) AS INT) + 1] + (q[least(CAST(floor(p) AS INT) + 1, 100) + 1] - q[CAST(floor(p) AS INT) + 1]) * (p - floor(p)), 5) AS calibrated FROM p, t")
def quantile_calibrate(spark: SparkSession, d: str) -> DataFrame:
    """ML30: the comment ratio in the distribution of the post ratio."""
    w = windows(spark, d)
    t = w.where("neg_ratio_post IS NOT NULL").agg(F.percentile("neg_ratio_post", [i / 100 for i in range(101)]).alias("q"))
    x = w.where("neg_ratio_comment IS NOT NULL").select("window_id", "official_uid", F.col("neg_ratio_comment").alias("v")).join(t)
    return rb.quantile_calibrate(x, ["official_uid"], "v", F.col("q")).select("window_id", r(F.col("calibrated"), 5).alias("calibrated"))


@query("WITH p AS (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS lo, median(p_retailprice) AS mid, quantile_cont(p_retailprice, 0.9) AS hi FROM part GROUP BY 1) SELECT p_partkey, round(hi - lo, 4) AS width, CAST(p_retailprice BETWEEN lo AND hi AS INT) AS covered, round(greatest(p_retailprice - hi, lo - p_retailprice, 0), 4) AS outside, round((p_retailprice - lo) / nullif(hi - lo, 0), 4) AS position, round((hi + lo - 2 * mid) / nullif(hi - lo, 0), 4) + 0.0 AS asymmetry FROM part JOIN p USING (p_brand)")
def interval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """SF35, SF17."""
    df = table(spark, d, "part")
    p = df.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.1).alias("lo"), F.median("p_retailprice").alias("mid"), F.percentile("p_retailprice", 0.9).alias("hi"))
    x, lo, hi = F.col("p_retailprice"), F.col("lo"), F.col("hi")
    w = F.nullif(hi - lo, F.lit(0.0))
    return df.join(p, "p_brand").select("p_partkey", r(hi - lo, 4).alias("width"), x.between(lo, hi).cast("int").alias("covered"), r(F.greatest(x - hi, lo - x, F.lit(0.0)), 4).alias("outside"), r((x - lo) / w, 4).alias("position"), r((hi + lo - 2 * F.col("mid")) / w, 4).alias("asymmetry"))


SCHEDULE = [("v1_major_first", "2025-02-01", "2025-04-01"), ("v1_major_second", "2025-04-01", "2025-06-01"), ("v2_minor_first", "2025-06-01", "2025-08-15"), ("v2_minor_second", "2025-08-15", "2025-12-31")]
_SCHED = "sched(name, s, e) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in SCHEDULE) + ")"


def _schedule(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(SCHEDULE, "name string, s string, e string")
    return df.select("name", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))


@query(f"WITH {WINDOWS}, {_SCHED} SELECT name, CASE WHEN contains(name, 'major') THEN 'major' ELSE 'minor' END AS size, CASE WHEN contains(name, 'first') THEN 'first' ELSE 'second' END AS half, count(*) AS n, round(avg(total_volume_comment), 6) AS mean, round(stddev_samp(total_volume_comment), 6) AS std, arg_max(window_id, (\"timestamp\", window_id)) - arg_min(window_id, (\"timestamp\", window_id)) AS delta FROM w19 JOIN sched ON \"timestamp\" >= s AND \"timestamp\" < e GROUP BY 1")
def version_range_stats(spark: SparkSession, d: str) -> DataFrame:
    """J6, AG22, SF24, ML29."""
    w = wn.interval_label(windows(spark, d), _schedule(spark), "timestamp", "s", "e", "name").where("name IS NOT NULL")
    k = F.struct("timestamp", "window_id")
    g = w.groupBy("name").agg(F.count(F.lit(1)).alias("n"), r(F.avg("total_volume_comment")).alias("mean"), r(F.stddev_samp("total_volume_comment")).alias("std"), (F.max_by("window_id", k) - F.min_by("window_id", k)).alias("delta"))
    return g.select("name", F.when(F.col("name").contains("major"), "major").otherwise("minor").alias("size"), F.when(F.col("name").contains("first"), "first").otherwise("second").alias("half"), "n", "mean", "std", "delta")


@query(f"WITH {WINDOWS}, a AS (SELECT strftime(\"timestamp\", '%H:%M') AS hm, avg(total_volume_comment) AS day_mean FROM w19 GROUP BY 1), b AS (SELECT (dayofweek(\"timestamp\") + 6) % 7 AS dow, avg(total_volume_comment) AS week_mean FROM w19 GROUP BY 1) SELECT window_id, round(coalesce(day_mean, 0) + coalesce(week_mean, 0), 6) AS seasonal FROM w19 LEFT JOIN a ON strftime(\"timestamp\", '%H:%M') = hm LEFT JOIN b ON (dayofweek(\"timestamp\") + 6) % 7 = dow")
def template_lookup(spark: SparkSession, d: str) -> DataFrame:
    """AG23, J12: daily and weekly profiles, looked up for each window."""
    w = windows(spark, d).withColumn("hm", F.date_format("timestamp", "HH:mm")).withColumn("dow", F.weekday("timestamp"))
    a = w.groupBy("hm").agg(F.avg("total_volume_comment").alias("day_mean"))
    b = w.groupBy("dow").agg(F.avg("total_volume_comment").alias("week_mean"))
    return w.join(a, "hm", "left").join(b, "dow", "left").select("window_id", r(F.coalesce("day_mean", F.lit(0.0)) + F.coalesce("week_mean", F.lit(0.0))).alias("seasonal"))


@query(f"WITH {WINDOWS}, m AS (SELECT date_trunc('month', \"timestamp\") AS month, max(\"timestamp\") AS last FROM w19 GROUP BY 1), h AS (SELECT w.window_id, w.\"timestamp\" > m.last - INTERVAL 4 DAY AS held FROM w19 w JOIN m ON date_trunc('month', w.\"timestamp\") = m.month) SELECT held, count(*) AS n, count(*) >= 96 AS enough FROM h GROUP BY 1")
def heldout_split(spark: SparkSession, d: str) -> DataFrame:
    """ML8."""
    w = windows(spark, d).withColumn("month", F.date_trunc("month", "timestamp"))
    m = w.groupBy("month").agg(F.max("timestamp").alias("last"))
    h = w.join(m, "month").withColumn("held", F.col("timestamp") > F.col("last") - F.expr("INTERVAL 4 DAYS"))
    n = F.count(F.lit(1))
    return h.groupBy("held").agg(n.alias("n"), (n >= 96).alias("enough"))


@query(f"WITH {WINDOWS}, q AS (SELECT official_uid, quantile_cont(total_volume_comment, 0.01) AS q1, quantile_cont(total_volume_comment, 0.99) AS q9, quantile_cont(total_volume_comment, 0.05) AS w5, quantile_cont(total_volume_comment, 0.95) AS w95 FROM w19 GROUP BY 1) SELECT window_id, coalesce(total_volume_comment < q1 - 10 * (q9 - q1) OR total_volume_comment > q9 + 10 * (q9 - q1), false) AS is_spike, round(least(greatest(total_volume_comment, w5), w95), 6) AS winsorized FROM w19 JOIN q USING (official_uid)")
def spike_detect(spark: SparkSession, d: str) -> DataFrame:
    """ML33, ML20."""
    w = windows(spark, d)
    q = w.groupBy("official_uid").agg(F.percentile("total_volume_comment", 0.05).alias("w5"), F.percentile("total_volume_comment", 0.95).alias("w95"))
    s = rb.spikes(w, ["official_uid"], "total_volume_comment").join(q, "official_uid")
    x = F.col("total_volume_comment")
    return s.select("window_id", "is_spike", r(F.when(x.isNotNull(), F.least(F.greatest(x, F.col("w5")), F.col("w95"))).otherwise(F.col("w5"))).alias("winsorized"))


_NUMBERED = f"{WINDOWS}, n AS (SELECT official_uid, window_id, CAST(total_volume_comment AS DOUBLE) AS x, coalesce(total_volume_comment > 8, true) AS bad, row_number() OVER (PARTITION BY official_uid ORDER BY window_id) AS i FROM w19)"


@query(f"WITH {_NUMBERED}, g AS (SELECT *, max(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY official_uid ORDER BY i ROWS UNBOUNDED PRECEDING) AS li, min(CASE WHEN NOT bad THEN i END) OVER (PARTITION BY official_uid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM n) SELECT g.window_id, round(CASE WHEN NOT g.bad THEN g.x ELSE coalesce(l.x + (r.x - l.x) * (g.i - g.li) / CAST(g.ri - g.li AS DOUBLE), l.x, r.x) END, 6) AS fixed FROM g LEFT JOIN n l ON g.official_uid = l.official_uid AND g.li = l.i LEFT JOIN n r ON g.official_uid = r.official_uid AND g.ri = r.i")
def spike_fix(spark: SparkSession, d: str) -> DataFrame:
    """WN19."""
    w = windows(spark, d).withColumn("bad", F.coalesce(F.col("total_volume_comment") > 8, F.lit(True)))
    return rb.fix_runs(w, ["official_uid"], "window_id", "total_volume_comment", "bad").select("window_id", r(F.col("fixed")).alias("fixed"))


@query(f"WITH {WINDOWS}, {OFFICIAL}, c AS (SELECT ts FROM official WHERE category = 'crisis' AND ts IS NOT NULL) SELECT window_id FROM w19 w WHERE NOT EXISTS (SELECT 1 FROM c WHERE w.\"timestamp\" BETWEEN c.ts - INTERVAL 2 HOUR AND c.ts + INTERVAL 2 HOUR)")
def normal_mask_pad(spark: SparkSession, d: str) -> DataFrame:
    """ML21, J17: windows away from every crisis post; anti-join on time buckets."""
    width = 4 * 3600
    b = lambda c: F.floor(F.unix_timestamp(c) / width)
    c = official(spark, d).where("category = 'crisis' AND ts IS NOT NULL").select("ts").distinct()
    c = c.select("ts", F.explode(F.array_distinct(F.array(b(F.col("ts") - F.expr("INTERVAL 2 HOURS")), b(F.col("ts") + F.expr("INTERVAL 2 HOURS"))))).alias("bucket"))
    w = windows(spark, d).withColumn("bucket", b(F.col("timestamp")))
    near = (w["bucket"] == c["bucket"]) & (F.col("timestamp") >= F.col("ts") - F.expr("INTERVAL 2 HOURS")) & (F.col("timestamp") <= F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return w.join(c, near, "left_anti").select("window_id")


_HALF = "TIMESTAMP '2025-06-15'"
_W1 = f"WITH {_LONG}, b AS (SELECT feature, value, sum(CAST(ts < {_HALF} AS DOUBLE)) AS wa, sum(CAST(ts >= {_HALF} AS DOUBLE)) AS wb FROM long GROUP BY 1, 2), k AS (SELECT feature, abs(sum(wa) OVER w / sum(wa) OVER (PARTITION BY feature) - sum(wb) OVER w / sum(wb) OVER (PARTITION BY feature)) AS a, lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS gap FROM b WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)), w1 AS (SELECT feature, sum(a * gap) AS distance, max(a) AS ks FROM k GROUP BY 1)"


@query(_W1 + " SELECT feature, round(distance, 5) AS distance, round(ks, 6) AS ks FROM w1")
def wasserstein1(spark: SparkSession, d: str) -> DataFrame:
    """ML32: between the first and the second part of the year."""
    long = _long(spark, d)
    half = f"TIMESTAMP_NTZ '{_HALF.split(chr(39))[1]} 00:00:00'"
    return rb.wasserstein(long.where(f"ts < {half}"), long.where(f"ts >= {half}"), ["feature"], "value").select("feature", r(F.col("distance"), 5).alias("distance"), r(F.col("ks")).alias("ks"))


_SKEW = "(avg(pow(value, 3)) FILTER ({0}) - 3 * avg(value) FILTER ({0}) * avg(value * value) FILTER ({0}) + 2 * pow(avg(value) FILTER ({0}), 3)) / nullif(pow(stddev_pop(value) FILTER ({0}), 3), 0)"


@query(
    f"{_W1}, s AS (SELECT feature, avg(value) FILTER (ts < {_HALF}) AS ma, avg(value) FILTER (ts >= {_HALF}) AS mb, stddev_pop(value) FILTER (ts < {_HALF}) AS sa, stddev_pop(value) FILTER (ts >= {_HALF}) AS sb, abs({_SKEW.format(f'ts < {_HALF}')} - {_SKEW.format(f'ts >= {_HALF}')}) AS ek FROM long GROUP BY 1), "
    "e AS (SELECT s.feature, abs(ma - mb) / greatest(abs(ma), 1e-6) AS em, abs(sa - sb) / greatest(sa, 1e-6) AS es, coalesce(ek, 0) AS ek, distance / greatest(sa, 1e-6) AS ed, ks FROM s JOIN w1 USING (feature)) "
    "SELECT feature, round(em, 5) AS mean_error, round(es, 5) AS std_error, round(ek, 3) AS skew_error, round(ed, 5) AS distance, round(ks, 6) AS ks, CASE WHEN em < 0.05 AND es < 0.1 AND ek < 0.25 AND ed < 0.05 THEN 'S' WHEN em < 0.1 AND es < 0.2 AND ek < 0.5 AND ed < 0.1 THEN 'A' WHEN em < 0.2 AND es < 0.4 AND ek < 1 AND ed < 0.2 THEN 'B' ELSE 'C' END AS grade FROM e"
)
def grade_card(spark: SparkSession, d: str) -> DataFrame:
    """ML31, ML32: how far the second part of the year is from the first in mean, deviation, skewness and distribution."""
    long = _long(spark, d)
    first = F.col("ts") < F.lit("2025-06-15 00:00:00").cast("timestamp_ntz")
    pick = lambda fn, c: fn(F.when(c, F.col("value")))
    s = long.groupBy("feature").agg(pick(F.avg, first).alias("ma"), pick(F.avg, ~first).alias("mb"), pick(F.stddev_pop, first).alias("sa"), pick(F.stddev_pop, ~first).alias("sb"), pick(F.skewness, first).alias("ka"), pick(F.skewness, ~first).alias("kb"))
    em = F.abs(F.col("ma") - F.col("mb")) / F.greatest(F.abs("ma"), F.lit(1e-6))
    es = F.abs(F.col("sa") - F.col("sb")) / F.greatest(F.col("sa"), F.lit(1e-6))
    ek = F.coalesce(tr.clean(F.abs(F.col("ka") - F.col("kb"))), F.lit(0.0))
    w = rb.wasserstein(long.where(first), long.where(~first), ["feature"], "value")
    e = s.join(w, "feature").select("feature", em.alias("em"), es.alias("es"), ek.alias("ek"), (F.col("distance") / F.greatest(F.col("sa"), F.lit(1e-6))).alias("ed"), "ks")
    grade = F.lit("C")
    for name, m, sd, k, dist in (("B", 0.2, 0.4, 1.0, 0.2), ("A", 0.1, 0.2, 0.5, 0.1), ("S", 0.05, 0.1, 0.25, 0.05)):
        grade = F.when((F.col("em") < m) & (F.col("es") < sd) & (F.col("ek") < k) & (F.col("ed") < dist), name).otherwise(grade)
    return e.select("feature", r(F.col("em"), 5).alias("mean_error"), r(F.col("es"), 5).alias("std_error"), r(F.col("ek"), 3).alias("skew_error"), r(F.col("ed"), 5).alias("distance"), r(F.col("ks")).alias("ks"), grade.alias("grade"))


@query(f"WITH {OFFICIAL}, {WINDOWS} SELECT official_uid, post_id, ts, window_id, round(abs(epoch_us(t) - epoch_us(ts)) / 1000000.0, 3) AS distance_s FROM (SELECT o.official_uid, o.post_id, o.ts, f.window_id, f.\"timestamp\" AS t, row_number() OVER (PARTITION BY o.official_uid, o.post_id, o.ts ORDER BY abs(epoch_us(f.\"timestamp\") - epoch_us(o.ts)), f.\"timestamp\", f.window_id) AS k FROM (SELECT DISTINCT official_uid, post_id, ts FROM official WHERE ts IS NOT NULL) o JOIN w19 f ON o.official_uid = f.official_uid AND f.\"timestamp\" BETWEEN o.ts - INTERVAL 900 SECOND AND o.ts + INTERVAL 900 SECOND) WHERE k = 1")
def nearest_window(spark: SparkSession, d: str) -> DataFrame:
    """J2: each official post with the window of its account that is nearest within a quarter of an hour."""
    posts = official(spark, d).where("ts IS NOT NULL").select("official_uid", "post_id", "ts").distinct()
    w = windows(spark, d).select("official_uid", "window_id", F.col("timestamp").alias("ts"))
    return wn.nearest_within(posts, w, ["official_uid"], "ts", "post_id", "window_id", 900).withColumn("distance_s", F.round("distance_s", 3))


_EVENTS = f"{OFFICIAL}, ev AS (SELECT DISTINCT CAST(floor((epoch(ts) + 450) / 900) AS BIGINT) AS slot, category FROM official WHERE ts IS NOT NULL AND category IS NOT NULL)"
_VOL = "vol AS (SELECT CAST(floor(epoch(\"timestamp\") / 900) AS BIGINT) AS slot, CAST(sum(total_volume_comment) AS DOUBLE) AS x FROM w19 GROUP BY 1)"


def _slots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = official(spark, d).where("ts IS NOT NULL AND category IS NOT NULL").select((wn.nearest_slot(F.col("ts")) / 900).cast("bigint").alias("slot"), "category").distinct()
    vol = windows(spark, d).groupBy(F.floor(F.unix_timestamp("timestamp") / 900).cast("bigint").alias("slot")).agg(F.sum("total_volume_comment").cast("double").alias("x"))
    return ev, vol


@query(f"WITH {WINDOWS}, {_EVENTS}, {_VOL} SELECT category, k, count(*) AS n, round(avg(x), 6) AS mean FROM ev, generate_series(0, 31) AS g(k), vol WHERE vol.slot = ev.slot + k GROUP BY ALL")
def event_response_curve(spark: SparkSession, d: str) -> DataFrame:
    """J2, ML15: mean volume in the 32 windows after each class of official posts."""
    ev, vol = _slots(spark, d)
    o = ev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("slot", F.col("slot") + F.col("k"))
    return o.join(vol, "slot").groupBy("category", F.col("k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean"))


@query(f"WITH {WINDOWS}, {_EVENTS}, {_VOL}, s AS (SELECT ev.slot + k AS slot, sum(CASE category WHEN 'promotion_main' THEN 1.0 WHEN 'maintenance' THEN 0.5 ELSE 0.2 END * exp(-k / 8.0)) AS shock FROM ev, generate_series(0, 31) AS g(k) WHERE category <> 'crisis' GROUP BY 1) SELECT vol.slot, round(coalesce(shock, 0), 6) AS shock, round(x + coalesce(shock, 0), 6) AS shocked FROM vol LEFT JOIN s ON vol.slot = s.slot")
def shock_injection(spark: SparkSession, d: str) -> DataFrame:
    """ML28, SF11: additive decaying shocks of all classes but crises."""
    ev, vol = _slots(spark, d)
    size = F.when(F.col("category") == "promotion_main", 1.0).when(F.col("category") == "maintenance", 0.5).otherwise(0.2)
    o = ev.where("category <> 'crisis'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31)))).select((F.col("slot") + F.col("k")).alias("slot"), (size * tr.exp_decay(F.col("k"), 1.0, 8.0)).alias("s"))
    s = o.groupBy("slot").agg(F.sum("s").alias("shock"))
    x = F.coalesce("shock", F.lit(0.0))
    return vol.join(s, "slot", "left").select("slot", r(x).alias("shock"), r(F.col("x") + x).alias("shocked"))


@query("SELECT t.target, e.encoder, CAST((row_number() OVER (ORDER BY t.target, e.encoder) - 1) % 2 AS BIGINT) AS seed_slot FROM (VALUES ('comment_pc1'), ('comment_pc2'), ('post_pc1'), ('post_pc2')) AS t(target), (VALUES (108), (192)) AS e(encoder)")
def cartesian_configs(spark: SparkSession, d: str) -> DataFrame:
    """J19: every target with every encoder length, seeds in turn; a table of eight rows."""
    t = spark.createDataFrame([(x,) for x in ("comment_pc1", "comment_pc2", "post_pc1", "post_pc2")], "target string").withColumn("encoder", F.explode(F.array(F.lit(108), F.lit(192)))).withColumn("one", F.lit(0))
    return t.withColumn("seed_slot", ((F.row_number().over(Window.partitionBy("one").orderBy("target", "encoder")) - 1) % 2).cast("bigint")).drop("one")


QUERIES, ORACLES = Q, O
