"""Problem 2: records of two tables paired by the nearest time of the same entity within a tolerance.

Method. A stateful streaming join. Both sides are buffered per entity in the state store of a stream-stream interval
join; the watermark evicts a buffered row once no partner within the tolerance can still come. Candidates flow into an
aggregation on the left row, which emits its nearest partner once the watermark has passed the row's tolerance
horizon. The state's changes are written to the shared folder, so lost executors cost no state; where it is kept in
between (memory or RocksDB) is the session's setting.

Scale. An entity may hold a third of all rows: the join key is the entity with a block of time, and a right row goes
to the one or two blocks that its tolerance reaches. Nothing is gathered per entity.

Replay of a finite table. Its rows are stored out of order, so one job cuts them into slices of event time by range, a
file for each, and a single stream reads one file in each micro-batch, in order: no row is behind the watermark and none
is dropped, while the state holds one slice and a horizon. A slice has about SLICE_ROWS rows whatever span of time that
is; only rows of one and the same instant can't be cut. A last marker far in the future moves the watermark past every
horizon. The stream runs in a session of its own, whose number of state partitions follows the size of a slice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clock
from tidemark.session import shared_dir
from tidemark.streaming import replay

#: Rows of both sides in a slice of the replay: bounds the state that the cluster holds at a time.
SLICE_ROWS = 4_000_000
#: Rows of a slice for each partition of the state.
STATE_ROWS = 100_000
_END = "__end__"


def nearest_stream(left: DataFrame, right: DataFrame, tolerance_s: int, lateness_s: int, block_s: int | None = None) -> DataFrame:
    """Streaming (entity, left_id, right_id): for each left row the nearest right row of its entity within the tolerance.

    left, right: streams of (entity, id, at TIMESTAMP). At equal distance the earlier right row, then the smaller id.
    Rows later than lateness_s behind the newest are late and dropped by the engine, as in any stream with a watermark.
    """
    block_us = (block_s or max(3600, 8 * tolerance_s)) * 1_000_000
    tol = tolerance_s * 1_000_000
    l = left.select(F.col("entity").alias("l_entity"), F.col("id").alias("l_id"), F.col("at").alias("l_at"), F.floor(F.unix_micros("at") / block_us).alias("l_block")).withWatermark("l_at", f"{lateness_s} seconds")
    reach = F.array_distinct(F.array(F.floor((F.unix_micros("at") - tol) / block_us), F.floor((F.unix_micros("at") + tol) / block_us)))
    r = right.select(F.col("entity").alias("r_entity"), F.col("id").alias("r_id"), F.col("at").alias("r_at"), F.explode(reach).alias("r_block")).withWatermark("r_at", f"{lateness_s} seconds")
    span = F.expr(f"INTERVAL {tolerance_s} SECONDS")
    pairs = l.join(r, (F.col("l_entity") == F.col("r_entity")) & (F.col("l_block") == F.col("r_block")) & (F.col("r_at") >= F.col("l_at") - span) & (F.col("r_at") <= F.col("l_at") + span))
    distance = F.abs(F.unix_micros("r_at") - F.unix_micros("l_at"))
    # the watermark reaches the aggregation reduced by the join's tolerance: a row is emitted when its horizon has passed
    best = pairs.groupBy("l_entity", "l_id", "l_at").agg(F.min(F.struct(distance.alias("d"), F.col("r_at").alias("t"), F.col("r_id").alias("i"))).alias("best"))
    return best.select(F.col("l_entity").alias("entity"), F.col("l_id").alias("left_id"), F.col("best.i").alias("right_id"), (F.col("best.d") / 1_000_000).alias("distance_s"))


def nearest_join(spark: SparkSession, left: DataFrame, right: DataFrame, tolerance_s: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The nearest partners of two finite tables of (entity, id BIGINT, at TIMESTAMP), replayed through the stream.

    Rows with a null entity, id or time can't be paired and are left out. Repeated rows give one row; rows of one id
    with different times are different rows. Left rows without a partner give none. Empty tables give an empty result.
    Other columns are not read.
    """
    both = left.select(F.lit(0).alias("side"), F.col("entity").cast("string").alias("entity"), F.col("id").cast("bigint").alias("id"), "at").unionByName(right.select(F.lit(1).alias("side"), F.col("entity").cast("string").alias("entity"), F.col("id").cast("bigint").alias("id"), "at"))
    both = both.dropna()
    base = shared_dir(spark, "nearest")
    sink = f"{base}/result"
    schema = "side int, entity string, id bigint, at timestamp"
    n = both.count()
    far = F.timestamp_micros(F.lit(253_000_000_000_000_000))
    end = spark.range(2).select(F.col("id").cast("int").alias("side"), F.lit(_END).alias("entity"), F.col("id"), far.alias("at"))
    # a file for each slice, in order of event time; repeated rows don't matter to the smallest partner
    source = replay.staged(both, "at", -(-n // slice_rows), end, base)
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(max(2, -(-min(n, slice_rows) // STATE_ROWS))))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    nearest = nearest_stream(stream.where("side = 0").select("entity", "id", "at"), stream.where("side = 1").select("entity", "id", "at"), tolerance_s, lateness_s=0)
    q = nearest.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).queryName(f"nearest-{uuid.uuid4().hex}").start()
    q.awaitTermination()
    result = "entity string, left_id bigint, right_id bigint, distance_s double"
    return spark.read.schema(result).parquet(sink).where(F.col("entity") != _END)


def at(ts: Column) -> Column:
    """A wall time as the event time of a stream."""
    return clock.instant(ts)
