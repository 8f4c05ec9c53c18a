"""Problems 2 and 6 against SQL twins, brute force and edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows_of, sql_rows
from tidemark.llm import nearest, queries_events, runs

T0 = dt.datetime(2025, 3, 30, 1, 0)


@pytest.mark.parametrize("name", sorted(queries_events.ORACLES))
def test_against_sql(spark, data, name):
    cols, rows = rows_of(queries_events.QUERIES[name](spark, data))
    want_cols, want = sql_rows(connect(data), queries_events.ORACLES[name])
    assert (cols, rows) == (want_cols, want)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    left = [("a" if rng.random() < 0.8 else "b", i, T0 + dt.timedelta(seconds=rng.randrange(40_000))) for i in range(150)]
    right = [("a" if rng.random() < 0.8 else "b", i, T0 + dt.timedelta(seconds=rng.randrange(0, 40_000, 60))) for i in range(300)]
    left += [left[0], ("a", 900, None), (None, 901, T0), ("c", 902, T0)]
    right += [right[0], ("a", None, T0), ("a", 903, None)]
    want = set()
    for e, i, t in set(left):
        near = [(abs((s - t).total_seconds()), s, j) for f, j, s in right if t and s and f == e and j is not None and abs((s - t).total_seconds()) <= 360]
        if near and e:
            want.add((e, i, min(near)[2]))
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "entity string, id bigint, ts timestamp_ntz, at string").select("entity", "id", nearest.at(F.col("ts")).alias("at"))
    got = nearest.nearest_join(spark, frame(left), frame(right), 360, slice_rows=120)
    assert {(r["entity"], r["left_id"], r["right_id"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_nearest_ties_and_bounds(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("a", 1, at(1000)), ("a", 2, at(3000)), ("a", 3, at(5000))], "entity string, id bigint, ts timestamp_ntz")
    right = spark.createDataFrame([("a", 9, at(900)), ("a", 8, at(1100)), ("a", 7, at(900)), ("a", 5, at(3360)), ("a", 6, at(5361))], "entity string, id bigint, ts timestamp_ntz")
    f = lambda d: d.select("entity", "id", nearest.at(F.col("ts")).alias("at"))
    got = {r["left_id"]: r["right_id"] for r in nearest.nearest_join(spark, f(left), f(right), 360).collect()}
    assert got == {1: 7, 2: 5}  # the earlier, then the smaller id; 360 s counts, 361 doesn't


def test_nearest_empty(spark):
    e = spark.createDataFrame([], "entity string, id bigint, at timestamp")
    assert nearest.nearest_join(spark, e, e, 360).count() == 0


def brute_runs(rows, gap):
    out = []
    for e in sorted({r[0] for r in rows}):
        line = sorted({(r[2], r[1], r[3]) for r in rows if r[0] == e})
        cur = None
        for t, k, label in line:
            if cur and cur["label"] == label and t - cur["end"] <= gap:
                cur.update(end=t, last=k, n=cur["n"] + 1)
            else:
                cur = {"label": label, "first": k, "last": k, "end": t, "n": 1}
                out.append((e, cur))
    return {(e, c["label"], c["first"], c["last"], c["n"]) for e, c in out}


@pytest.mark.parametrize("block", [900, 3000, 10**9])
def test_runs_equal_brute_force_across_blocks(spark, block):
    rng = random.Random(block)
    rows, t = [], 0.0
    for k in range(400):
        t += rng.choice([0, 300, 900, 900, 1800, 1801])
        rows.append(("hot" if k % 5 else "cold", k, t, rng.choice("NNNA")))
    rows += rows[:50]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, 1, 1.0, "N", 1), ("hot", None, 1.0, "N", 1), ("hot", 1, None, "N", 1), ("hot", 2, 2.0, None, 1)], "uid string, k bigint, s double, label string, n int")
    got = runs.collapse_runs(df, "uid", F.col("s"), "k", F.col("label"), 1800, block_seconds=block)
    assert {(r["entity"], r["label"], r["first_key"], r["last_key"], r["n"]) for r in got.collect()} == brute_runs(rows, 1800)


def test_most_similar_neighbours_merge_first():
    # 0.0 0.4 0.5: the closer pair merges first, and its mean is then too far from the rest
    run = runs.agglomerate(["a"] * 3, [[0.0], [0.4], [0.5]], [0, 1, 2], [0, 1, 2], [1, 1, 1], [True, True, False], 0.65, 10)
    assert run == [0, 1, 1]


def test_runs_empty(spark):
    df = spark.createDataFrame([], "uid string, k bigint, s double, label string")
    assert runs.collapse_runs(df, "uid", F.col("s"), "k", F.col("label"), 1800).count() == 0


def test_labels_fold(spark):
    df = spark.createDataFrame([(x,) for x in ("N", "Ｎ", " n ", "AP", "ｐa", "CP", "　ca")], "pred_label string")
    assert [r[0] for r in df.select(queries_events.plain_label(F.col("pred_label"))).collect()] == ["N", "N", "N", "PA", "PA", "CA", "CA"]


def test_a_label_may_hold_any_sign(spark, tmp_path):
    """The flag is told from the label by the last sign, and labels of any kind of blank or width are one."""
    from tidemark.llm.queries_events import p6_runs

    at = lambda k: dt.datetime(2025, 3, 1) + dt.timedelta(minutes=15 * k)
    rows = [("u", k, at(k), label, drift, 0.0) for k, (label, drift) in enumerate((("a|b", True), (" Ａ｜B\u3000", True), ("|", None), ("", False), ("x", False), ("X", None)))]
    spark.createDataFrame(rows, "official_uid string, time_idx bigint, timestamp timestamp_ntz, pred_label string, is_baseline_drift boolean, collective_density double").write.parquet(f"{tmp_path}/adaptive_detection_resultv5.parquet")
    got = {(r["pred_label"], r["is_baseline_drift"], r["first_time_idx"], r["n_windows"]) for r in p6_runs(spark, str(tmp_path)).collect()}
    assert got == {("A|B", True, 0, 2), ("|", False, 2, 1), ("", False, 3, 1), ("X", False, 4, 2)}
