"""Queries of signals, detection, segments, incidents and the adaptive controller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.operators import detect as dt
from tidemark.operators import lifecycle as lc
from tidemark.operators.labels import plain_label, plain_label_sql
from tidemark.plans.common import DETECTIONS, POSTS, WINDOWS, detections, posts, r, windows
from tidemark.session import materialize, shared_dir
from tidemark.streaming import adaptive, replay

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


#: Share of each account's windows, from its first, that detection is calibrated on.
QUIET_SHARE = 0.25
#: The published thresholds.
T = dt.Thresholds()
_MODELS = ("model_comment_pc1", "model_post_pc1")

# ---- signals: attention and variable weights are the rows of the two feature groups
_POST = ["gini_post", "comp_ratio_post", "neg_ratio_post", "semantic_shift_post", "retweet_ratio_post"]
_COMMENT = ["gini_comment", "comp_ratio_comment", "neg_ratio_comment", "semantic_shift_comment"]


def _arr(cols):
    return F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in cols))


_BASE = f"SELECT official_uid, quantile_cont(neg_ratio_post, 0.05) AS p5, quantile_cont(neg_ratio_post, 0.95) AS p95, stddev_pop(neg_ratio_post) AS sd, {', '.join(f'avg(coalesce({c}, 0)) AS m_{c}' for c in _POST + _COMMENT)} FROM (SELECT *, percent_rank() OVER (PARTITION BY official_uid ORDER BY \"timestamp\") AS q FROM w19) WHERE q < {QUIET_SHARE} GROUP BY 1"


def _prob_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: (abs(x) + 1e-10) / list_sum(list_transform({v}, lambda y: abs(y) + 1e-10)))"


def _rank_sql(v: str) -> str:
    return f"list_transform(generate_series(1, len({v})), lambda i: len(list_filter(generate_series(1, len({v})), lambda j: {v}[j] > {v}[i] OR ({v}[j] = {v}[i] AND j < i))))"


@query(
    f"""WITH {WINDOWS}, base AS ({_BASE}), x AS (SELECT w.window_id, w.neg_ratio_post AS res, p5, p95, sd,
  [{', '.join(f'coalesce(w.{c}, 0.0)' for c in _POST)}] AS a, [{', '.join(f'm_{c}' for c in _POST)}] AS am,
  [{', '.join(f'coalesce(w.{c}, 0.0)' for c in _COMMENT)}] AS v, [{', '.join(f'm_{c}' for c in _COMMENT)}] AS vm
  FROM w19 w LEFT JOIN base b ON w.official_uid = b.official_uid),
 p AS (SELECT *, {_prob_sql('a')} AS pa, {_prob_sql('am')} AS qa, {_prob_sql('v')} AS pv, {_prob_sql('vm')} AS qv FROM x),
 k AS (SELECT *, {_rank_sql('pv')} AS rp, {_rank_sql('qv')} AS rq FROM p)
 SELECT window_id, CASE WHEN p95 IS NOT NULL THEN round(least(greatest(abs(res) / greatest(abs(p95), abs(p5), 1.645 * abs(sd), 1e-10), 0), 20), 6) END AS residual_ratio,
  CASE WHEN am[1] IS NOT NULL THEN round(least(list_sum(list_transform(list_zip(pa, qa), lambda z: z[1] * ln(z[1] / z[2]))), 20), 6) + 0.0 END AS att_kl,
  CASE WHEN am[1] IS NOT NULL THEN round(least(list_sum(list_transform(list_zip(pv, qv), lambda z: 0.5 * z[1] * ln(2 * z[1] / (z[1] + z[2])) + 0.5 * z[2] * ln(2 * z[2] / (z[1] + z[2])))), 5), 6) + 0.0 END AS vsn_js,
  CASE WHEN am[1] IS NOT NULL THEN round(6.0 * list_sum(list_transform(list_zip(rp, rq), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / (4 * 15.0), 6) END AS vsn_rank_shift FROM k"""
)
def deviation_signals(spark: SparkSession, d: str) -> DataFrame:
    """DT1, SF14 to SF17: each account's windows against the first share of its own; null signals where the baseline has no values."""
    w = windows(spark, d)
    quiet = w.withColumn("q_", F.percent_rank().over(Window.partitionBy("official_uid").orderBy("timestamp"))).where(F.col("q_") < QUIET_SHARE)
    base = quiet.groupBy("official_uid").agg(F.percentile("neg_ratio_post", 0.05).alias("p5"), F.percentile("neg_ratio_post", 0.95).alias("p95"), F.stddev_pop("neg_ratio_post").alias("sd"), F.array(*(F.avg(F.coalesce(F.col(c), F.lit(0.0))) for c in _POST)).alias("am"), F.array(*(F.avg(F.coalesce(F.col(c), F.lit(0.0))) for c in _COMMENT)).alias("vm"))
    x = w.join(base, "official_uid", "left")
    out = dt.deviation_signals(x, F.col("neg_ratio_post"), _arr(_POST), _arr(_COMMENT), F.col("p5"), F.col("p95"), F.col("sd"), F.col("am"), F.col("vm"), "m")
    # the greatest of the scales skips nulls: without a baseline a ratio would be 0 or 20
    known = {s: F.col("p95" if s == "residual_ratio" else "am").isNotNull() for s in dt.SIGNALS}
    return out.select("window_id", *(F.when(known[s], r(F.col(f"m_{s}"))).alias(s) for s in ("residual_ratio", "att_kl", "vsn_js", "vsn_rank_shift")))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    sig = [f"{m}_{s}" for m in _MODELS for s in dt.SIGNALS]
    df = detections(spark, d).select("official_uid", "time_idx", "timestamp", *sig)
    return dt.roll_signals(df, ["official_uid"], "time_idx", sig, 8)


_SIG = [f"{m}_{s}" for m in _MODELS for s in dt.SIGNALS]
_ROLLED = f"s AS (SELECT DISTINCT official_uid, time_idx, \"timestamp\" AS ts, {', '.join(_SIG)} FROM adaptive_detection_resultv5), rolled AS (SELECT official_uid, time_idx, ts, {', '.join(f'coalesce({c}, 0) AS {c}, coalesce(max({c}) OVER w, 0) AS {c}_rollmax_8' for c in _SIG)} FROM s WINDOW w AS (PARTITION BY official_uid ORDER BY time_idx ROWS 7 PRECEDING))"


@query(f"WITH {_ROLLED} SELECT official_uid, time_idx, {', '.join(f'round({c}_rollmax_8, 6) AS {c}_rollmax_8' for c in _SIG)} FROM rolled")
def rolling_max8(spark: SparkSession, d: str) -> DataFrame:
    """DT2, WN1, PF14."""
    return _signals(spark, d).select("official_uid", "time_idx", *(r(F.col(f"{c}_rollmax_8")).alias(f"{c}_rollmax_8") for c in _SIG))


_Z = "greatest(" + ", ".join(f"({c} - mean_{c}) / std_{c}" for c in T.level_columns()) + ")"
_QUIET_SQL = f"q < {QUIET_SHARE}"
_PRED = f"""WITH {_ROLLED.replace("rolled AS", "unranked AS")}, rolled AS (SELECT *, percent_rank() OVER (PARTITION BY official_uid ORDER BY time_idx) AS q FROM unranked),
 p1 AS (SELECT official_uid, {', '.join(f'avg({c}_rollmax_8) + 5.0 * stddev_samp({c}_rollmax_8) AS thr_{c}' for c in _SIG)}, {', '.join(f'avg({c}) AS mean_{c}, greatest(coalesce(stddev_samp({c}), 0), {f}) AS std_{c}' for c, f in T.level_columns().items())} FROM rolled WHERE {_QUIET_SQL} GROUP BY 1),
 p2 AS (SELECT q.official_uid, avg({_Z}) + 3.0 * stddev_samp({_Z}) AS level_thr, stddev_samp({_Z}) * {T.volatility_factor} AS vol_thr, avg({_Z}) + 2.0 * stddev_samp({_Z}) AS drift_thr FROM rolled q JOIN p1 USING (official_uid) WHERE {_QUIET_SQL} GROUP BY 1),
 z AS (SELECT r.*, {_Z} AS z, {' + '.join(f'CAST({c}_rollmax_8 > thr_{c} AS INT)' for c in _SIG)} AS votes, level_thr, vol_thr, drift_thr FROM rolled r JOIN p1 USING (official_uid) JOIN p2 USING (official_uid)),
 x AS (SELECT *, CASE WHEN count(z) OVER a >= {T.collective_least} THEN avg(CAST(z > level_thr AS DOUBLE)) OVER a END AS density, CASE WHEN count(z) OVER a >= {T.collective_least} THEN stddev_samp(z) OVER a END AS vol, CASE WHEN count(z) OVER b >= {T.drift_least} THEN avg(z) OVER b END AS trend, lag(ts, {T.collective_rows}) OVER (PARTITION BY official_uid ORDER BY time_idx) AS l3, lag(ts, {T.drift_lag}) OVER (PARTITION BY official_uid ORDER BY time_idx) AS l14 FROM z WINDOW a AS (PARTITION BY official_uid ORDER BY time_idx ROWS {T.collective_rows - 1} PRECEDING), b AS (PARTITION BY official_uid ORDER BY time_idx ROWS {T.drift_rows - 1} PRECEDING)),
 y AS (SELECT *, coalesce(density > {T.density} AND vol < vol_thr, false) AS ca, coalesce(trend > drift_thr, false) AS cp FROM x),
 pred AS (SELECT *, CASE WHEN ca THEN 'CA' WHEN votes >= 4 THEN 'PA' ELSE 'N' END AS label FROM y)
"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    quiet = s.withColumn("q_", F.percent_rank().over(Window.partitionBy("official_uid").orderBy("time_idx"))).where(F.col("q_") < QUIET_SHARE).drop("q_")
    return dt.predict(s, dt.calibrate(quiet, ["official_uid"], T), ["official_uid"], "time_idx", "timestamp", T)


@query(_PRED + "SELECT official_uid, time_idx, round(z, 6) AS static_signal_z_max, round(density, 6) AS collective_density, round(vol, 5) AS collective_volatility, round(trend, 6) AS changepoint_trend_mean, cp AS is_changepoint, votes AS point_trigger_count, label AS pred_label, CASE WHEN label = 'CA' THEN l3 WHEN label = 'PA' THEN ts END AS attribution_time, CASE WHEN cp THEN l14 END AS changepoint_attribution_time FROM pred")
def detect_labels(spark: SparkSession, d: str) -> DataFrame:
    """DT3 to DT7 (flagship): calibrated on the first part of each account's windows."""
    return _predicted(spark, d).select("official_uid", "time_idx", r(F.col("static_signal_z_max")).alias("static_signal_z_max"), r(F.col("collective_density")).alias("collective_density"), r(F.col("collective_volatility"), 5).alias("collective_volatility"), r(F.col("changepoint_trend_mean")).alias("changepoint_trend_mean"), "is_changepoint", "point_trigger_count", "pred_label", "attribution_time", "changepoint_attribution_time")


def _dom(parts, like) -> str:
    sums = {p: " + ".join(f"CAST({c}_rollmax_8 > thr_{c} AS INT)" for c in _SIG if like(p, c)) for p in parts}
    best = "greatest(" + ", ".join(sums.values()) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {best} THEN '{p}'" for p, s in sums.items()) + " END"


_DOM_PRED = _PRED.replace("level_thr, vol_thr, drift_thr FROM rolled r", f"level_thr, vol_thr, drift_thr, {_dom(T.models, lambda p, c: p in c)} AS dm, {_dom(dt.SIGNALS, lambda p, c: c.endswith(p))} AS ds FROM rolled r")


@query(_DOM_PRED + "SELECT dm AS dominant_model, ds AS dominant_signal, count(*) AS n FROM pred WHERE label = 'PA' GROUP BY ALL")
def dominant_votes(spark: SparkSession, d: str) -> DataFrame:
    """DT6, ST6."""
    return _predicted(spark, d).where("pred_label = 'PA'").groupBy("dominant_model", "dominant_signal").agg(F.count(F.lit(1)).alias("n"))


_TRIG_PRED = _PRED.replace("level_thr, vol_thr, drift_thr FROM rolled r", "level_thr, vol_thr, drift_thr, [" + ", ".join(f"CASE WHEN {c}_rollmax_8 > thr_{c} THEN '{c}_rollmax_8' END" for c in _SIG) + "] AS fs FROM rolled r")


@query(_TRIG_PRED + "SELECT f AS feature, count(*) AS n FROM (SELECT unnest(fs) AS f FROM pred WHERE label = 'PA') WHERE f IS NOT NULL GROUP BY 1")
def trigger_frequency(spark: SparkSession, d: str) -> DataFrame:
    """DT13."""
    return _predicted(spark, d).where("pred_label = 'PA'").select(F.explode(F.split("trigger_features", r"\|")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


# ---- segments and incidents, over the stored labels
_LAB = plain_label_sql("pred_label")
_LABELS = f"lab AS (SELECT DISTINCT official_uid, time_idx, \"timestamp\" AS ts, {_LAB} AS label FROM adaptive_detection_resultv5 WHERE pred_label IS NOT NULL)"
_SEGS = f"{_LABELS}, b AS (SELECT *, CASE WHEN label = lag(label) OVER w AND epoch(ts) - epoch(lag(ts) OVER w) <= 900 THEN 0 ELSE 1 END AS c FROM lab WINDOW w AS (PARTITION BY official_uid ORDER BY ts)), g AS (SELECT *, sum(c) OVER (PARTITION BY official_uid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM b), segs AS (SELECT official_uid, label, CAST(seg AS BIGINT) AS segment, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n FROM g GROUP BY official_uid, label, seg HAVING label <> 'N')"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """PF18: stored labels in one code."""
    return detections(spark, d).where("pred_label IS NOT NULL").select("official_uid", "time_idx", F.col("timestamp").alias("ts"), plain_label(F.col("pred_label")).alias("label")).distinct()


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return lc.segments(_labels(spark, d), ["official_uid"], "ts", "label")


@query(f"WITH {_SEGS} SELECT * FROM segs")
def anomaly_segments(spark: SparkSession, d: str) -> DataFrame:
    """DT11, WN8, AG24."""
    return _segments(spark, d)


POOL = [(1, 2, "2025-03-24 00:00:00", "2025-04-08 08:00:00", "2025-04-10 12:00:00", "2025-04-20 00:00:00"), (2, 1, "2025-08-18 06:00:00", "2025-08-20 09:00:00", "2025-08-24 18:00:00", "2025-08-30 00:00:00"), (3, 3, "2025-11-01 00:00:00", "2025-11-08 12:00:00", "2025-11-10 09:00:00", "2025-11-14 00:00:00")]
_POOL_SQL = "pool(incident_id, level, t_start, t_peak, t_resp, t_end) AS (VALUES " + ", ".join(f"({i}, {l}, " + ", ".join(f"TIMESTAMP '{t}'" for t in ts) + ")" for i, l, *ts in POOL) + ")"


def _pool(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(POOL, "incident_id int, level int, t_start string, t_peak string, t_resp string, t_end string")
    return df.select("incident_id", "level", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("t_start", "t_peak", "t_resp", "t_end")))


@query(f"WITH {_SEGS}, {_POOL_SQL} SELECT * FROM segs s WHERE EXISTS (SELECT 1 FROM pool p WHERE s.\"start\" <= p.t_end AND s.\"end\" >= p.t_start)")
def crisis_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    """J7."""
    return lc.overlapping(_segments(spark, d), _pool(spark))


@query(f"WITH {_LABELS}, {_POOL_SQL}, c AS (SELECT label, CASE WHEN ts < t_peak THEN 'growth' WHEN ts < t_resp THEN 'outbreak' ELSE 'decline' END AS phase, incident_id FROM lab JOIN pool ON ts BETWEEN t_start AND t_end WHERE label <> 'N'), k AS (SELECT phase, label, count(*) AS n, count(DISTINCT incident_id) AS n_incidents FROM c GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM k")
def phase_share(spark: SparkSession, d: str) -> DataFrame:
    """AG26, DT12, J6."""
    c = lc.in_incident(_labels(spark, d).where("label <> 'N'"), _pool(spark), "ts")
    k = c.groupBy("phase", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("incident_id").alias("n_incidents"))
    return k.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("label"))))


@query(f"WITH {_LABELS}, {_POOL_SQL}, a AS (SELECT * FROM lab WHERE label <> 'N') SELECT p.incident_id, p.level, min(a.ts) AS first_alarm, arg_min(a.label, (a.ts, a.label)) AS first_label, round((epoch(p.t_peak) - epoch(min(a.ts))) / 60.0, 6) AS minutes_before_peak, count(*) FILTER (a.label = 'PA') AS n_pa, count(*) FILTER (a.label = 'CA') AS n_ca, count(a.ts) AS n_alarms FROM pool p LEFT JOIN a ON a.ts BETWEEN p.t_start AND p.t_end GROUP BY p.incident_id, p.level, p.t_peak")
def lead_time(spark: SparkSession, d: str) -> DataFrame:
    """AG27, AG25."""
    return lc.first_warnings(_labels(spark, d), _pool(spark), "ts", "label").select("incident_id", "level", "first_alarm", "first_label", r(F.col("minutes_before_peak")).alias("minutes_before_peak"), "n_pa", "n_ca", "n_alarms")


@query(f"WITH {_LABELS}, {_POOL_SQL} SELECT p.level, count(*) FILTER (label = 'CA') AS CA, count(*) FILTER (label = 'PA') AS PA, count(*) FILTER (label = 'N') AS N FROM lab JOIN pool p ON ts BETWEEN t_start AND t_end GROUP BY p.level")
def level_pivot(spark: SparkSession, d: str) -> DataFrame:
    """AG28."""
    c = lc.in_incident(_labels(spark, d), _pool(spark), "ts")
    return c.groupBy("level").pivot("label", ["CA", "PA", "N"]).count().fillna(0)


@query(f"WITH {_LABELS}, {POSTS}, a AS (SELECT DISTINCT ts AS at FROM lab WHERE label = 'CA') SELECT post_id FROM posts p WHERE ts IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE p.ts > a.at - INTERVAL 15 MINUTE AND p.ts <= a.at)")
def alert_lookback_semi(spark: SparkSession, d: str) -> DataFrame:
    """J8, SO5: raw posts in any alarm's window, each once."""
    a = _labels(spark, d).where("label = 'CA'").select(F.col("ts").alias("at"))
    return lc.in_any_window(posts(spark, d).where("ts IS NOT NULL"), a, "ts", "at").select("post_id")


@query(f"WITH {_LABELS}, {POSTS}, a AS (SELECT official_uid || '/' || time_idx AS alarm_id, ts AS at FROM lab WHERE label = 'CA'), j AS (SELECT a.alarm_id, p.text, count(*) AS m FROM a JOIN posts p ON p.ts > a.at - INTERVAL 15 MINUTE AND p.ts <= a.at WHERE p.text IS NOT NULL GROUP BY ALL), g AS (SELECT alarm_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS k FROM j GROUP BY 1) SELECT DISTINCT a.alarm_id, coalesce(n, 0) AS n, coalesce(k, 0) AS n_distinct, round(coalesce(1 - k / n, 0), 6) AS repeat_ratio FROM a LEFT JOIN g ON a.alarm_id = g.alarm_id")
def alert_window_agg(spark: SparkSession, d: str) -> DataFrame:
    """J9, AG21, AG29, DT14: the evidence of each alarm."""
    a = _labels(spark, d).where("label = 'CA'").select(F.concat_ws("/", "official_uid", "time_idx").alias("alarm_id"), F.col("ts").alias("at"))
    out = lc.evidence(a, posts(spark, d).where("ts IS NOT NULL"), "alarm_id", "at", "ts", "text")
    return out.select("alarm_id", "n", "n_distinct", r(F.col("repeat_ratio")).alias("repeat_ratio"))


#: The parts of each account's windows that the two baselines are calibrated on, and the relaxation of a new one.
BASELINES, RELAX = ((0.0, QUIET_SHARE), (QUIET_SHARE, 2 * QUIET_SHARE)), 1.2
LIMITS = adaptive.Limits()
#: Rows of a slice of a replayed table.
SLICE_ROWS = 4_000_000


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """The labels that both baselines give each window, in batches."""
    s = _signals(spark, d).where("official_uid IS NOT NULL")
    ranked = s.withColumn("q_", F.percent_rank().over(Window.partitionBy("official_uid").orderBy("time_idx")))
    both = None
    for i, (lo, hi) in enumerate(BASELINES):
        quiet = ranked.where((F.col("q_") >= lo) & (F.col("q_") < hi)).drop("q_")
        out = dt.predict(s, dt.calibrate(quiet, ["official_uid"], T), ["official_uid"], "time_idx", "timestamp", T, relaxed=RELAX)
        out = out.select("official_uid", "time_idx", F.lit(i).alias("baseline"), F.col("pred_label").alias("label"), "relaxed_label", F.col("is_changepoint").alias("drift"))
        both = out if both is None else both.unionByName(out)
    return adaptive.summarise(both, "official_uid", "time_idx")


def _baseline_sql(i: int) -> str:
    lo, hi = BASELINES[i]
    fewer = " + ".join(f"CAST({c}_rollmax_8 > thr_{c} * {RELAX} AS INT)" for c in _SIG)
    own = _PRED.replace(_QUIET_SQL, f"q >= {lo} AND q < {hi}").replace("AS votes,", f"AS votes, {fewer} AS fewer,")
    return f"{own} SELECT official_uid, time_idx, {i} AS baseline, label, CASE WHEN ca THEN 'CA' WHEN fewer >= 4 THEN 'PA' ELSE 'N' END AS relaxed, cp FROM pred WHERE official_uid IS NOT NULL"


def _batches_sql() -> str:
    sums = ", ".join(f"count(*) FILTER (baseline = {i} AND label = 'CA') AS ca{i}, coalesce(bool_or(baseline = {i} AND cp), false) AS drift{i}, count(*) FILTER (baseline = {i} AND label = 'N') AS calm{i}, count(*) FILTER (baseline = {i} AND relaxed = 'N') AS warm{i}" for i in (0, 1))
    return f"WITH both_ AS (SELECT * FROM ({_baseline_sql(0)}) UNION ALL SELECT * FROM ({_baseline_sql(1)})) SELECT official_uid AS series, max(time_idx) AS moment, count(*) FILTER (baseline = 0) AS n_rows, {sums} FROM both_ GROUP BY official_uid, time_idx // 24"


def machine_sql(batches: str, k: adaptive.Limits) -> str:
    """The controller as a recursion over batches: every series advances by one batch in each step."""
    pick = lambda c, by="version": f"CASE WHEN {by} % 2 = 0 THEN {c}0 ELSE {c}1 END"
    # one level for each step of thought: the batch, the observation, the comparison, the verdict
    joined = f"SELECT m.* EXCLUDE (moment, s1, a1, start1, n1, v1, a2), b.moment AS b_at, b.n_rows AS b_rows, {pick('b.ca')} AS ca, {pick('b.drift')} AS drift, {pick('b.calm')} AS calm_now, {pick('b.calm', '(version + 1)')} AS calm_new, {pick('b.warm', '(version + 1)')} AS warm_new, CASE WHEN b.moment < until THEN 'COOLDOWN' WHEN state = 'COOLDOWN' THEN 'NORMAL' ELSE state END AS st FROM m JOIN b ON m.series = b.series AND m.k + 1 = b.k"
    counted = f"SELECT *, CASE WHEN st = 'NORMAL' AND ca > 0 THEN ca WHEN st = 'CA_TENTATIVE' AND ca > 0 THEN counter + ca WHEN st IN ('NORMAL', 'CA_TENTATIVE') THEN greatest(0, counter - 1) ELSE counter END AS n, collected + b_rows AS c, st NOT IN ('COOLDOWN', 'SWITCHING') AND drift AS dr FROM ({joined})"
    seen = f"""SELECT *, CASE WHEN dr THEN 'FINETUNE_FROM_HISTORY' WHEN st = 'CA_TENTATIVE' AND n >= {k.confirm} THEN 'START_FORWARD_COLLECTION' WHEN st = 'ACCUMULATING' AND c >= {k.accumulate} THEN 'FINETUNE_FROM_FORWARD_DATA' ELSE 'NONE' END AS a1,
      CASE WHEN dr THEN greatest(0, b_at - {k.retrace}) WHEN st = 'CA_TENTATIVE' AND n >= {k.confirm} THEN b_at WHEN st = 'ACCUMULATING' AND c >= {k.accumulate} THEN greatest(0, b_at - c + 1) END AS start1,
      CASE WHEN dr THEN 'SWITCHING' WHEN st = 'CA_TENTATIVE' AND n >= {k.confirm} THEN 'ACCUMULATING' WHEN st = 'ACCUMULATING' AND c >= {k.accumulate} THEN 'SWITCHING' WHEN st IN ('NORMAL', 'CA_TENTATIVE') THEN CASE WHEN n > 0 THEN 'CA_TENTATIVE' ELSE 'NORMAL' END ELSE st END AS s1,
      CASE WHEN dr THEN counter ELSE n END AS n1, CASE WHEN dr THEN collected WHEN st = 'CA_TENTATIVE' AND n >= {k.confirm} THEN 0 WHEN st = 'ACCUMULATING' THEN c ELSE collected END AS c1,
      CASE WHEN dr THEN 'drift' WHEN st = 'ACCUMULATING' AND c >= {k.accumulate} THEN 'collective' ELSE track END AS t1 FROM ({counted})"""
    side = f"SELECT *, s1 = 'SWITCHING' AND a1 = 'NONE' AS par, seen + b_rows AS seen1, old + calm_now AS old1, new + CASE WHEN since < {k.warmup} THEN warm_new ELSE calm_new END AS new1 FROM ({seen})"
    verdict = f"""SELECT *, CASE WHEN NOT par OR seen1 < CASE WHEN extended THEN {k.extension} ELSE {k.parallel} END THEN 'NONE' WHEN new1 / seen1 >= {k.stability} AND (t1 <> 'collective' OR new1 >= old1) THEN 'ACCEPT_NEW_BASELINE'
      WHEN t1 = 'collective' AND old1 / seen1 >= {k.recovery} THEN 'REJECT_NEW_BASELINE' WHEN NOT extended THEN 'EXTEND_PARALLEL_VALIDATION' ELSE 'REJECT_NEW_BASELINE' END AS a2 FROM ({side})"""
    end, more = "a2 IN ('ACCEPT_NEW_BASELINE', 'REJECT_NEW_BASELINE')", "a2 = 'EXTEND_PARALLEL_VALIDATION'"
    step = f"""SELECT series, k + 1 AS k, CASE WHEN {end} THEN 'COOLDOWN' ELSE s1 END AS state, CASE WHEN {end} THEN 0 ELSE n1 END AS counter, CASE WHEN {end} THEN 0 ELSE c1 END AS collected, CASE WHEN {end} OR {more} THEN 0 WHEN par THEN seen1 ELSE seen END AS seen, CASE WHEN {end} THEN false ELSE extended OR {more} END AS extended,
      CASE WHEN {end} THEN '' ELSE t1 END AS track, CASE WHEN {end} THEN b_at + {k.cooldown} ELSE until END AS until, version + CAST(a2 = 'ACCEPT_NEW_BASELINE' AS INT) AS version, CASE WHEN {end} OR {more} THEN 0 WHEN par THEN old1 ELSE old END AS old, CASE WHEN {end} OR {more} THEN 0 WHEN par THEN new1 ELSE new END AS new,
      CASE WHEN {end} THEN 0 WHEN par THEN since + b_rows ELSE since END AS since, b_at AS moment, s1, a1, start1, n1, version AS v1, a2 FROM ({verdict})"""
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series ORDER BY moment) AS k FROM ({batches})),
 m AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS k, 'NORMAL' AS state, CAST(0 AS BIGINT) AS counter, CAST(0 AS BIGINT) AS collected, CAST(0 AS BIGINT) AS seen, false AS extended, '' AS track, CAST(-1 AS BIGINT) AS until, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS old, CAST(0 AS BIGINT) AS new, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS moment, '' AS s1, '' AS a1, CAST(NULL AS BIGINT) AS start1, CAST(0 AS BIGINT) AS n1, CAST(0 AS BIGINT) AS v1, 'NONE' AS a2 FROM b
  UNION ALL {step})
 SELECT series, moment AS "at", s1 AS state, a1 AS action, start1 AS data_start, n1 AS counter, v1 AS version FROM m WHERE k > 0 UNION ALL SELECT series, moment, state, a2, NULL, counter, version FROM m WHERE a2 <> 'NONE'"""


@query(machine_sql(_batches_sql(), LIMITS))
def state_machine_batch(spark: SparkSession, d: str) -> DataFrame:
    """DT8 to DT10 as an ordered fold."""
    return adaptive.fold(_batches(spark, d), LIMITS)


@query(machine_sql(_batches_sql(), LIMITS))
def stream_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """DT8 to DT10 as a stateful stream over the batches, replayed to its end."""
    base = shared_dir(spark, "controller")
    _batches(spark, d).repartition(4, "series").write.parquet(f"{base}/source")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/source").schema).parquet(f"{base}/source")
    out = adaptive.stream(src, LIMITS)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"WITH {_LABELS} SELECT time_bucket(INTERVAL '15 minutes', ts) AS w, label, count(*) AS n FROM lab WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows with a watermark of an hour and removal of repeated rows, as a stream in order of event time.

    Windows and remembered ids are evicted as the watermark passes them: the state holds a slice and an hour.
    """
    base = shared_dir(spark, "tumbling")
    rows = _labels(spark, d).where("ts IS NOT NULL").select(F.concat_ws("/", "official_uid", "time_idx").alias("id"), "label", F.expr("timestamp_seconds(unix_timestamp(ts))").alias("at"))
    last = spark.range(1).select(F.lit("").alias("id"), F.lit("").alias("label"), F.expr("timestamp_seconds(4102444800)").alias("at"))
    source = replay.staged(rows, "at", -(-rows.count() // SLICE_ROWS), last, base)
    src = spark.readStream.schema("id string, label string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = src.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id", "label", "at"]).groupBy(F.window("at", "15 minutes"), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("w"), "label", "n")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    res = spark.read.schema("w timestamp, label string, n bigint").parquet(f"{base}/out")
    return res.where("label <> ''").withColumn("w", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(w))"))


QUERIES, ORACLES = Q, O
