"""Time grids, rolling windows with least counts, islands, and joins by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = "15 minutes"


def slot(ts: Column, width: str = GRID) -> Column:
    """Start of the tumbling window that holds a time."""
    return F.window(ts, width)["start"]


def time_index(ts: Column, base: Column, width_s: int = 900) -> Column:
    """Whole windows from the base, cut toward zero."""
    return ((F.unix_timestamp(ts) - F.unix_timestamp(base)) / width_s).cast("bigint")


def spine(df: DataFrame, keys: list[str], ts: str, step: str = "INTERVAL 15 MINUTES") -> DataFrame:
    """Every grid slot between a key's first and last slot; (keys, ts). The grid is generated, not shuffled."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("lo_"), F.max(ts).alias("hi_"))
    return span.select(*keys, F.explode(F.sequence("lo_", "hi_", F.expr(step))).alias(ts))


def rows_back(partition: list[str], order: list[str | Column], n: int):
    """The last n rows up to the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0)


def rolling(fn, x: Column, w, least: int = 1) -> Column:
    """fn(x) over the window where it has at least `least` values that aren't null."""
    return F.when(F.count(x).over(w) >= least, fn(x).over(w))


def islands(change: Column, partition: list[str], order: list[str | Column]) -> Column:
    """Number of the run that a row belongs to; `change` marks the first row of a run."""
    return F.sum(change.cast("int")).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], tie_left_last: bool = True) -> DataFrame:
    """left with the columns of the latest right row of its key at or before its time; null where there is none.

    Both sides are united and carried forward in one window: one shuffle, no inequality join.
    """
    r = right.select(*keys, F.col(ts), F.struct(F.col(ts).alias("right_ts"), *columns).alias("r_"), F.lit(0).alias("side_"))
    l = left.withColumn("r_", F.lit(None).cast(r.schema["r_"].dataType)).withColumn("side_", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(ts, "side_").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("r_", F.last("r_", ignorenulls=True).over(w))
    return both.where("side_ = 1").select(*left.columns, *(F.col(f"r_.{c}").alias(c) for c in ["right_ts", *columns]))


def lookback_pairs(points: DataFrame, events: DataFrame, ts: str, at: str, width_s: int, closed_left: bool = False) -> DataFrame:
    """All (point, event) with at - width < ts <= at, as an equi-join on time buckets and an exact filter.

    A bucket is as wide as the window, so a point meets the events of its bucket and the next one only.
    """
    p = points.withColumn("bucket_", F.explode(F.array(F.floor(F.unix_timestamp(ts) / width_s), F.floor(F.unix_timestamp(ts) / width_s) + 1)))
    e = events.withColumn("bucket_", F.floor(F.unix_timestamp(at) / width_s))
    low = F.col(at) - F.expr(f"INTERVAL {width_s} SECONDS")
    inside = (F.col(ts) >= low) if closed_left else (F.col(ts) > low)
    return p.join(e, "bucket_").where(inside & (F.col(ts) <= F.col(at))).drop("bucket_")


def nearest_slot(ts: Column, width_s: int = 900) -> Column:
    """The grid slot nearest to a time, as seconds; a time midway goes to the later one."""
    return (F.floor((F.unix_timestamp(ts) + width_s / 2) / width_s) * width_s).cast("bigint")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], ts: str, left_id: str, right_id: str, tolerance_s: int) -> DataFrame:
    """(keys, left_id, ts, right_id, distance_s): the right row nearest in time within the tolerance; the earlier, then the
    smaller id where two are equally near. Left rows without one give none.

    An equi-join on the keys and a time block, so a hot key is many groups; a right row goes to one or two blocks. The
    nearest is picked by an aggregation with map-side combine.
    """
    width, us = 8 * tolerance_s * 1_000_000, lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.select(*keys, F.col(left_id).alias("l_"), F.col(ts), us(ts).alias("t_")).withColumn("block_", F.floor(F.col("t_") / width))
    reach = F.array_distinct(F.array(*(F.floor((F.col("u_") + d * tolerance_s * 1_000_000) / width) for d in (-1, 1))))
    r = right.select(*keys, F.col(right_id).alias("r_"), us(ts).alias("u_")).withColumn("block_", F.explode(reach))
    near = l.join(r, [*keys, "block_"]).where(F.abs(F.col("u_") - F.col("t_")) <= tolerance_s * 1_000_000)
    best = near.groupBy(*keys, "l_", ts).agg(F.min(F.struct(F.abs(F.col("u_") - F.col("t_")).alias("d"), F.col("u_").alias("u"), F.col("r_").alias("r"))).alias("b_"))
    return best.select(*keys, F.col("l_").alias(left_id), ts, F.col("b_.r").alias(right_id), (F.col("b_.d") / 1_000_000).alias("distance_s"))


def interval_label(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, name: str, closed: bool = False) -> DataFrame:
    """points with the name of the first interval (by start, then name) that holds their time; null where none does.

    Intervals are a schedule: few, planned by their size, and sorted into one array, so no point is ever multiplied.
    """
    schedule = intervals.agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(name).alias("n")))).alias("schedule_"))
    holds = lambda p: (F.col(ts) >= p["s"]) & ((F.col(ts) <= p["e"]) if closed else (F.col(ts) < p["e"]))
    return points.join(schedule).withColumn(name, F.get(F.filter("schedule_", holds), F.lit(0))["n"]).drop("schedule_")


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")
