"""Segments of alarms, their meeting with incidents, and the evidence around an alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import islands, lookback_pairs


def segments(df: DataFrame, series: list[str], ts: str, label: str, max_gap_s: int = 900, drop: tuple[str, ...] = ("N",)) -> DataFrame:
    """(series, label, start, end, n, segment): runs of one label without a gap beyond max_gap_s; normal runs left out."""
    w = Window.partitionBy(*series).orderBy(ts)
    gap = F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lag(ts).over(w))
    change = F.coalesce((F.col(label) != F.lag(label).over(w)) | (gap > max_gap_s), F.lit(True))
    marked = df.withColumn("change_", change).withColumn("segment", islands(F.col("change_"), series, [ts]))
    out = marked.groupBy(*series, "segment", label).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where(~F.col(label).isin(*drop)) if drop else out


def _pool(incidents: DataFrame) -> DataFrame:
    """The incidents, a pool that people keep, as one row with an array; every row is compared with the array, none is multiplied."""
    return incidents.agg(F.collect_list(F.struct(*incidents.columns)).alias("pool_"))


def overlapping(segs: DataFrame, incidents: DataFrame) -> DataFrame:
    """Segments that overlap any incident; incidents (a pool of few rows) have t_start and t_end."""
    met = F.exists("pool_", lambda p: (F.col("start") <= p["t_end"]) & (F.col("end") >= p["t_start"]))
    return segs.join(_pool(incidents.select("t_start", "t_end"))).where(met).select(segs.columns)


def phase(ts: Column, peak: Column, response: Column) -> Column:
    return F.when(ts < peak, "growth").when(ts < response, "outbreak").otherwise("decline")


def in_incident(df: DataFrame, incidents: DataFrame, ts: str) -> DataFrame:
    """Rows with the incident that holds their time and its phase; a row in two incidents comes out twice."""
    held = F.filter("pool_", lambda p: (F.col(ts) >= p["t_start"]) & (F.col(ts) <= p["t_end"]))
    j = df.join(_pool(incidents)).select(*df.columns, F.inline(held))
    return j.withColumn("phase", phase(F.col(ts), F.col("t_peak"), F.col("t_resp")))


def first_warnings(df: DataFrame, incidents: DataFrame, ts: str, label: str) -> DataFrame:
    """One row for each incident: first alarm, its label, minutes before peak and response, alarms by label; zeros if none."""
    alarms = df.where(F.col(label) != "N").select(F.col(ts).alias("t_"), F.col(label).alias("l_"))
    # aggregated by incident first, with map-side combine; a row for each incident is joined back
    seen = in_incident(alarms, incidents.select("incident_id", "t_start", "t_end", "t_peak", "t_resp"), "t_").groupBy("incident_id").agg(
        F.min("t_").alias("first_alarm"),
        F.min_by("l_", F.struct("t_", "l_")).alias("first_label"),
        *(F.count_if(F.col("l_") == x).alias(f"n_{x.lower()}") for x in ("PA", "CA")),
        F.count("t_").alias("n_alarms"),
    )
    lead = lambda c: (F.unix_timestamp(c) - F.unix_timestamp("first_alarm")) / 60.0
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return incidents.join(seen, "incident_id", "left").select("incident_id", "level", "t_peak", "t_resp", "first_alarm", "first_label", lead("t_peak").alias("minutes_before_peak"), lead("t_resp").alias("minutes_before_response"), zero("n_pa"), zero("n_ca"), zero("n_alarms"))


def evidence(alarms: DataFrame, raw: DataFrame, alarm_id: str, at: str, ts: str, text: str, width_s: int = 900) -> DataFrame:
    """(alarm_id, n, n_distinct, repeat_ratio, texts) of the raw rows in (at - width, at]; alarms without rows have zeros.

    texts joins the three longest distinct texts; the longest are picked by a bounded aggregate, not from all texts.
    """
    pairs = lookback_pairs(raw.select(ts, text), alarms.select(alarm_id, at), ts, at, width_s)
    per_text = pairs.where(F.col(text).isNotNull()).groupBy(alarm_id, text).agg(F.count(F.lit(1)).alias("m_"))
    w = Window.partitionBy(alarm_id).orderBy(F.desc(F.char_length(text)), text)
    ranked = per_text.withColumn("k_", F.row_number().over(w))
    agg = ranked.groupBy(alarm_id).agg(
        F.sum("m_").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k_") <= 3, F.struct("k_", F.col(text).alias("t"))))), lambda s: s["t"]), " | ").alias("texts"),
    )
    out = alarms.select(alarm_id).distinct().join(agg, alarm_id, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(alarm_id, n.alias("n"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce(1 - F.try_divide(F.col("n_distinct"), n), F.lit(0.0)).alias("repeat_ratio"), F.coalesce("texts", F.lit("")).alias("texts"))


def in_any_window(raw: DataFrame, alarms: DataFrame, ts: str, at: str, width_s: int = 900) -> DataFrame:
    """Raw rows inside any alarm's lookback window, each once: a semi-join on time buckets."""
    a = alarms.select(F.col(at).alias("a_")).distinct()
    e = a.withColumn("b_", F.explode(F.array(F.floor(F.unix_timestamp("a_") / width_s), F.floor(F.unix_timestamp("a_") / width_s) - 1)))
    p = raw.withColumn("b_", F.floor(F.unix_timestamp(ts) / width_s))
    inside = (p["b_"] == e["b_"]) & (F.col(ts) > F.col("a_") - F.expr(f"INTERVAL {width_s} SECONDS")) & (F.col(ts) <= F.col("a_"))
    return p.join(e, inside, "left_semi").drop("b_")
