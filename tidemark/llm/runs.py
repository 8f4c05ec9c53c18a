"""Problem 6: runs of equal or similar consecutive events, collapsed into one event each.

Method. Adjacent agglomeration: the events of an entity form a linked list of runs; a priority queue holds every pair
of neighbours that meets the similarity and gap limits, and the most similar pair (then the one with the shorter gap,
then the earlier) is merged until none is left. A merged run's neighbours are queued anew; entries of runs that have
changed since are skipped.

Scale. An entity may hold a third of all rows, so its time line is cut into blocks of fixed length and each block is
agglomerated by itself. A run that is neither first nor last in its block is final. The others, at most two for each
block, are agglomerated once more over the entity's whole line; their number is bounded by the blocks of the time
range, however many events there are. For equal labels (similarity 0 or 1) this gives exactly the runs of one pass
over the whole line. With features a merge moves a run's mean, so a line is cut only where neighbours can never merge,
at another label or a gap beyond the limit; the stretches between cuts go to the block that they begin in and are
agglomerated there once, which is exact too. A stretch is never split, so a group is as long as the longest of them.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BLOCK_SECONDS = 14 * 86_400


def agglomerate(label: list, vec: list[list[float]], start: list[float], end: list[float], size: list[int], linked: list[bool], min_similarity: float, max_gap: float) -> list[int]:
    """The first item of the run of each item; items are in order of time.

    vec: mean features of each item, all of one length, may be empty. The similarity of two runs is 0 if their labels
    differ, else exp(-L1 distance of their means): 1 for equal events. linked[i]: items i and i + 1 are neighbours.
    """
    n = len(size)
    vec, end, size = [list(v) for v in vec], list(end), list(size)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    tail, live, version = list(range(n)), [True] * n, [0] * n
    queue: list[tuple] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and linked[tail[i]] and label[i] == label[j] and (gap := start[j] - end[i]) <= max_gap:
            s = math.exp(-sum(abs(a - b) for a, b in zip(vec[i], vec[j]))) if vec[i] else 1.0
            if s >= min_similarity:
                heapq.heappush(queue, (-s, gap, i, version[i], version[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, _, i, vi, vj = heapq.heappop(queue)
        j = nxt[i]
        if not live[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        total = size[i] + size[j]
        vec[i] = [(a * size[i] + b * size[j]) / total for a, b in zip(vec[i], vec[j])]
        size[i], end[i], tail[i], live[j] = total, max(end[i], end[j]), tail[j], False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        version[i] += 1
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    head, out = 0, []
    for i in range(n):
        head = i if live[i] else head
        out.append(head)
    return out


_COLUMNS = ("block", "pos", "label", "first_key", "last_key", "start_s", "end_s", "n", "features")


def _merged(col: dict[str, list], min_similarity: float, max_gap: float, whole: bool) -> dict[str, list]:
    """The runs of one group of items in order of time; whole: all neighbours are linked, else those of a block only if
    they followed each other there."""
    block, pos, weight, vec = col["block"], col["pos"], col["n"], [list(v) for v in col["features"]]
    linked = [whole or block[i] != block[i + 1] or pos[i + 1] - pos[i] == 1 for i in range(len(pos) - 1)] + [False]
    run = agglomerate(col["label"], vec, col["start_s"], col["end_s"], weight, linked, min_similarity, max_gap)
    head = [i for i, r in enumerate(run) if r == i]
    tail = [b - 1 for b in head[1:]] + [len(run) - 1]
    out = {c: [col[c][i] for i in head] for c in ("label", "first_key", "start_s")}
    out["last_key"] = [col["last_key"][i] for i in tail]
    out["end_s"] = [max(col["end_s"][a : b + 1]) for a, b in zip(head, tail)]
    out["n"] = [sum(weight[a : b + 1]) for a, b in zip(head, tail)]
    out["features"] = [[sum(w * v[k] for w, v in zip(weight[a : b + 1], vec[a : b + 1])) / sum(weight[a : b + 1]) for k in range(len(vec[a]))] for a, b in zip(head, tail)]
    out["pos"] = list(range(len(head)))
    out["edge"] = [k in (0, len(head) - 1) for k in range(len(head))]
    return out


def _by_group(df: DataFrame, keys: list[str], schema: str, min_similarity: float, max_gap: float) -> DataFrame:
    """The runs of each group, as a pass over partitions sorted by group and time: no call and no frame for each group."""
    whole = "own" in keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait: list[pd.DataFrame] = []

        def done(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            if not len(pdf):
                return
            cuts = [*np.flatnonzero(_changes(pdf)), len(pdf)]
            lists = {c: pdf[c].tolist() for c in (*_COLUMNS, *keys)}
            out: dict[str, list] = defaultdict(list)
            for a, b in zip(cuts, cuts[1:]):
                runs = _merged({c: lists[c][a:b] for c in _COLUMNS}, min_similarity, max_gap, whole)
                for c, v in runs.items():
                    out[c] += v
                out["entity"] += [lists["entity"][a]] * len(runs["n"])
                out["block"] += [lists[keys[-1]][a] if whole else 0] * len(runs["n"])
            yield pd.DataFrame(out)

        def _changes(pdf: pd.DataFrame) -> np.ndarray:
            change = np.zeros(len(pdf), bool)
            change[0] = True
            for k in keys:
                v = pdf[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return change

        for pdf in batches:
            if not len(pdf):
                continue
            last = int(np.flatnonzero(_changes(pdf))[-1])
            if last == 0 and wait and all(wait[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys):
                wait.append(pdf)  # one group goes on
                continue
            wait.append(pdf.iloc[:last])
            yield from done(wait)
            wait = [pdf.iloc[last:]]
        if wait:
            yield from done(wait)

    order = ["start_s", "first_key", "pos"]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def collapse_runs(df: DataFrame, entity: str, time_s: Column, key: str, label: Column, max_gap: float, min_similarity: float = 1.0, features: list[Column] | None = None, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row for each run: entity, label, first_key, last_key, start_s, end_s, n (events), duration_s, features (means).

    time_s: event time in seconds; key: a BIGINT that orders events of equal time. Repeated rows (equal in all that is
    read) count once. Rows with a null entity, time, key or label are left out: they can't be placed; a null feature
    counts as 0. An empty table gives no rows. Other columns of df, whatever their names, are not read.
    """
    kind = df.schema[entity].dataType.simpleString()
    schema = f"entity {kind}, block bigint, label string, first_key bigint, last_key bigint, start_s double, end_s double, n bigint, features array<double>, pos bigint, edge boolean"
    fs = [F.coalesce(f.cast("double"), F.lit(0.0)) for f in features or []]
    events = (
        df.select(F.col(entity).alias("entity"), label.cast("string").alias("label"), F.col(key).cast("bigint").alias("first_key"), time_s.cast("double").alias("start_s"), (F.array(*fs) if fs else F.array().cast("array<double>")).alias("features"))
        .dropna()
        .distinct()
    )
    one = events.select("entity", F.floor(F.col("start_s") / block_seconds).alias("block"), "label", "first_key", F.col("first_key").alias("last_key"), "start_s", F.col("start_s").alias("end_s"), F.lit(1).cast("bigint").alias("n"), "features")
    # in a block of events, all neighbours in order are linked: each event is its own block there
    single = one.withColumn("pos", F.lit(0).cast("bigint")).withColumn("own", F.col("block"))
    if fs:  # the block in which the event's stretch begins
        line = Window.partitionBy("entity").orderBy("start_s", "first_key", "label", "features")
        joined = (F.lag("label").over(line) == F.col("label")) & (F.col("start_s") - F.lag("start_s").over(line) <= max_gap)
        begin = single.withColumn("pos", F.row_number().over(line).cast("bigint")).withColumn("begin", F.when(~F.coalesce(joined, F.lit(False)), F.col("start_s")))
        begin = begin.withColumn("begin", F.last("begin", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        single = begin.withColumn("own", F.floor(F.col("begin") / block_seconds)).drop("begin")
    merged = _by_group(single, ["entity", "own"], schema, min_similarity, max_gap)
    if fs:
        return _shown(merged)
    runs = materialize(merged, "runs")
    return _shown(_by_group(runs.where("edge"), ["entity"], schema, min_similarity, max_gap).unionByName(runs.where("not edge")))


def _shown(out: DataFrame) -> DataFrame:
    return out.select("entity", "label", "first_key", "last_key", "start_s", "end_s", "n", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "features")
