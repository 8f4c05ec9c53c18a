"""Queries of problems 2 and 6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clock, nearest, runs
from tidemark.operators.labels import plain_label
from tidemark.sources.tables import table

MAX_GAP_SECONDS = 1800
def _label(df: DataFrame) -> Column:
    return F.concat_ws("|", plain_label(F.col("pred_label")), F.coalesce(F.col("is_baseline_drift"), F.lit(False)).cast("string"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "adaptive_detection_resultv5").where(F.col("pred_label").isNotNull())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of at least two windows of one account with equal label and drift flag, gaps up to 30 minutes."""
    df = _windows(spark, sf_dir)
    out = runs.collapse_runs(df, "official_uid", clock.seconds(F.col("timestamp")), "time_idx", _label(df), MAX_GAP_SECONDS)
    return out.where("n >= 2").select(F.col("entity").alias("official_uid"), F.col("first_key").alias("first_time_idx"), F.col("last_key").alias("last_time_idx"), F.col("n").alias("n_windows"))


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, single windows too, with label, flag, count and duration."""
    df = _windows(spark, sf_dir)
    out = runs.collapse_runs(df, "official_uid", clock.seconds(F.col("timestamp")), "time_idx", _label(df), MAX_GAP_SECONDS)
    flag = F.substring_index("label", "|", -1)  # a label may hold the sign, the flag behind the last one doesn't
    return out.select(F.col("entity").alias("official_uid"), F.expr("left(label, length(label) - length(substring_index(label, '|', -1)) - 1)").alias("pred_label"), (flag == "true").alias("is_baseline_drift"), F.col("first_key").alias("first_time_idx"), F.col("last_key").alias("last_time_idx"), F.col("n").alias("n_windows"), F.col("duration_s").cast("bigint").alias("duration_s"))


def p6_similar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of near-identical windows: equal label, collective density within reach of the run's mean."""
    df = _windows(spark, sf_dir)
    out = runs.collapse_runs(df, "official_uid", clock.seconds(F.col("timestamp")), "time_idx", _label(df), MAX_GAP_SECONDS, min_similarity=0.8, features=[F.col("collective_density")])
    return out.select(F.col("entity").alias("official_uid"), "label", F.col("first_key").alias("first_time_idx"), F.col("last_key").alias("last_time_idx"), F.col("n").alias("n_windows"), F.round(F.col("features")[0], 6).alias("mean_density"))


TOLERANCE_SECONDS = 360


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each official post with the nearest feature window of its account within six minutes."""
    posts = table(spark, sf_dir, "temp_all_official_standart_time_type").where("official_post_type is not null").select(F.col("official_uid").alias("entity"), F.col("post_id").alias("id"), nearest.at(F.col("timestamp")).alias("at"))
    windows = table(spark, sf_dir, "features_19").select(F.col("official_uid").alias("entity"), F.col("window_id").alias("id"), nearest.at(F.col("timestamp")).alias("at"))
    return nearest.nearest_join(spark, posts, windows, TOLERANCE_SECONDS).select(F.col("left_id").alias("post_id"), F.col("right_id").alias("window_id"))


_NEAREST_SQL = """
SELECT post_id, window_id FROM (
  SELECT p.post_id, f.window_id, row_number() OVER (PARTITION BY p.post_id, p.ts ORDER BY abs(epoch_us(f.ts) - epoch_us(p.ts)), f.ts, f.window_id) AS k
  FROM (SELECT DISTINCT post_id, official_uid, "timestamp" AS ts FROM temp_all_official_standart_time_type WHERE official_post_type IS NOT NULL AND "timestamp" IS NOT NULL) p
  JOIN (SELECT DISTINCT window_id, official_uid, "timestamp" AS ts FROM features_19 WHERE "timestamp" IS NOT NULL) f
    ON p.official_uid = f.official_uid AND f.ts BETWEEN p.ts - INTERVAL 360 SECOND AND p.ts + INTERVAL 360 SECOND) WHERE k = 1
"""

_RUNS_SQL = """
WITH e AS (
  SELECT DISTINCT official_uid, time_idx, "timestamp" AS ts, coalesce(is_baseline_drift, false) AS drift,
    CASE l WHEN 'AP' THEN 'PA' WHEN 'CP' THEN 'CA' ELSE l END AS label
  FROM (SELECT *, upper(trim(translate(pred_label, 'ＡＣＮＰａｃｎｐ　', 'ACNPacnp '))) AS l FROM adaptive_detection_resultv5)
  WHERE pred_label IS NOT NULL AND official_uid IS NOT NULL AND time_idx IS NOT NULL AND "timestamp" IS NOT NULL),
b AS (SELECT *, CASE WHEN label = lag(label) OVER w AND drift = lag(drift) OVER w
    AND epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS brk
  FROM e WINDOW w AS (PARTITION BY official_uid ORDER BY ts, time_idx)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY official_uid ORDER BY ts, time_idx) AS run FROM b)
"""

QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_runs": p6_runs, "p6_similar_runs": p6_similar_runs}
ORACLES = {
    "p2_found": _NEAREST_SQL,
    "p6_found": _RUNS_SQL + "SELECT official_uid, arg_min(time_idx, (ts, time_idx)) AS first_time_idx, arg_max(time_idx, (ts, time_idx)) AS last_time_idx, count(*) AS n_windows FROM g GROUP BY official_uid, run HAVING count(*) >= 2",
    "p6_runs": _RUNS_SQL + "SELECT official_uid, any_value(label) AS pred_label, any_value(drift) AS is_baseline_drift, arg_min(time_idx, (ts, time_idx)) AS first_time_idx, arg_max(time_idx, (ts, time_idx)) AS last_time_idx, count(*) AS n_windows, cast(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS duration_s FROM g GROUP BY official_uid, run",
}
