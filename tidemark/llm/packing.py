"""Problem 8: filling containers of a fixed capacity with items of varying size.

Method. Bounded-space online packing. Each partition keeps OPEN_WINDOWS open containers; an item goes to the open
container that it fills best (least space left); if none can take it, the fullest open container is emitted and a new
one is opened. At its end a partition leaves its open containers; these are merged, whole, by the same rule in levels of
MERGE_FAN partitions each, until one partition is left, so that each level holds at most OPEN_WINDOWS x MERGE_FAN rows
in a task. An item is split only if it alone exceeds the capacity, into full containers and one rest.

Scale. Sizes are computed where the texts are read; only (id, size) is shuffled, once, into partitions of about
ITEMS_PER_PARTITION items by a hash of the id, which also spreads repeated ids and hot sources. Inside a partition the
items stream in the order of a hash, so a lost task is repeated with the same result and space is bounded.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

OPEN_WINDOWS = 64
ITEMS_PER_PARTITION = 100_000
MERGE_FAN = 32


class OpenWindows:
    """A bounded number of open containers, found by best fit in a sorted list of (space left, number)."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free, self.next = capacity, limit, [], 0

    def place(self, size: int) -> tuple[int, int | None]:
        """(number of the container that takes the item, number of the container emitted for it or None)."""
        k = bisect.bisect_left(self.free, (size, -1))
        emitted = None
        if k < len(self.free):
            left, number = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                emitted = self.free.pop(0)[1]  # the fullest
            left, number = self.capacity, self.next
            self.next += 1
        bisect.insort(self.free, (left - size, number))
        return number, emitted

    def left(self) -> dict[int, int]:
        return {number: left for left, number in self.free}


def _pack(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Streams (budget_id, capacity, part, key, size) sorted by part and budget; adds local container numbers.

    `open` marks containers that were still open at the end of their part.
    """
    state: OpenWindows | None = None
    group: tuple | None = None
    rows: list[tuple] = []

    def close() -> pd.DataFrame:
        free = state.left() if state else {}
        out = pd.DataFrame(rows, columns=["budget_id", "capacity", "part", "key", "size", "local"])
        out["open"] = out["local"].isin(free)
        return out

    for pdf in batches:
        for b, c, p, k, s in zip(pdf["budget_id"], pdf["capacity"], pdf["part"], pdf["key"], pdf["size"]):
            if (b, p) != group:
                if rows:
                    yield close()
                group, state, rows = (b, p), OpenWindows(int(c), limit), []
            local, _ = state.place(int(s))
            rows.append((b, c, p, k, s, local))
    if rows:
        yield close()


_PACKED = "budget_id int, capacity int, part bigint, key string, size bigint, local bigint, open boolean"


def pack(items: DataFrame, budgets: list[tuple[int, int]], open_windows: int = OPEN_WINDOWS, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(budget_id, container_id, key, piece, offset, size): every item of every budget in a container.

    items: (key STRING, size BIGINT), one row for each item; budgets: (budget_id, capacity), a handful. piece and offset
    number the parts of a split item; both are 0 for an item that is whole. Items of null or zero size take no space and
    come out with a null container. Null keys, ties and repeated rows are kept as they are. An empty table of items or
    budgets gives no rows. Other columns are not read.
    """
    budgets = sorted({(int(b), int(c)) for b, c in budgets if c and c > 0})
    each = F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in budgets)) if budgets else F.array().cast("array<struct<budget_id:int,capacity:int>>")
    sized = materialize(items.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    n = sized.count()
    parts = max(1, -(-n // items_per_partition))
    wanted = sized.select("key", "size", "row", F.inline(each))
    none = wanted.where("size = 0").select("budget_id", F.lit(None).cast("string").alias("container_id"), "key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("offset"), "size")
    whole = F.floor(F.col("size") / F.col("capacity"))
    # an item beyond the capacity: full containers of its own, and a rest that is packed like an item
    pieces = wanted.where("size > 0").withColumn("full", F.when(F.col("size") > F.col("capacity"), whole).otherwise(0))
    full = (
        pieces.where("full > 0")
        .select("budget_id", "key", "row", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
        .select("budget_id", F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("container_id"), "key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("offset"), F.col("capacity").cast("bigint").alias("size"))
    )
    rest = pieces.select("budget_id", "capacity", "key", "row", "full", (F.col("size") - F.col("full") * F.col("capacity")).alias("size")).where("size > 0").withColumn("part", F.pmod(F.xxhash64(F.coalesce("key", F.col("row").cast("string")), F.lit(1)), F.lit(parts)))
    numbered = rest.withColumn("key", F.to_json(F.struct(F.col("key").alias("k"), F.col("full").alias("f"))))
    packed = _level(numbered, open_windows)
    packed = materialize(packed.withColumn("container_id", F.concat_ws("-", F.col("part").cast("string"), F.col("local").cast("string"))), "packed")

    # leftovers: the open containers as items of their own, merged in levels
    moves = None
    loose = packed.where("open").groupBy("budget_id", "capacity", "part", "container_id").agg(F.sum("size").alias("size"))
    while parts > 1:
        parts = -(-parts // MERGE_FAN)
        items_ = loose.select("budget_id", "capacity", F.floor(F.col("part") / MERGE_FAN).alias("part"), F.col("container_id").alias("key"), "size")
        level = materialize(_level(items_, open_windows), "leftovers").withColumn("to", F.concat_ws("-", F.lit(f"m{parts}"), F.col("part").cast("string"), F.col("local").cast("string")))
        step = level.select("budget_id", F.col("key").alias("from"), "to")
        moves = step if moves is None else moves.join(step.select("budget_id", F.col("from").alias("to"), F.col("to").alias("to2")), ["budget_id", "to"], "left").select("budget_id", "from", F.coalesce("to2", "to").alias("to"))
        loose = level.where("open").groupBy("budget_id", "capacity", "part", F.col("to").alias("container_id")).agg(F.sum("size").alias("size"))
    out = packed
    if moves is not None:
        out = packed.join(moves.withColumnRenamed("from", "container_id"), ["budget_id", "container_id"], "left").withColumn("container_id", F.coalesce("to", "container_id"))
    parsed = F.from_json("key", "k string, f bigint")
    out = out.withColumn("item", parsed).select("budget_id", "container_id", F.col("item.k").alias("key"), F.col("item.f").cast("int").alias("piece"), (F.col("item.f") * F.col("capacity")).alias("offset"), "size")
    return out.unionByName(full).unionByName(none)


def _level(items: DataFrame, open_windows: int) -> DataFrame:
    """One level of packing: a task streams its parts one after the other."""
    ordered = items.withColumn("order_", F.xxhash64("key", "size")).repartition("budget_id", "part").sortWithinPartitions("budget_id", "part", "order_", "key")
    return ordered.select("budget_id", "capacity", "part", "key", F.col("size").cast("bigint").alias("size")).mapInPandas(lambda it: _pack(it, open_windows), _PACKED)
