"""Signals, classifier, controller: published unit cases and golden values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.streaming import adaptive as ad


def test_signals(spark):
    rows = [(1, 0.5, [0.7, 0.3], [0.6, 0.4]), (2, -1.0, [0.2, 0.8], [0.1, 0.9])]
    df = spark.createDataFrame(rows, "time_idx int, residual double, attention array<double>, vsn array<double>")
    half = F.array(F.lit(0.5), F.lit(0.5))
    out = detect.deviation_signals(df, F.col("residual"), F.col("attention"), F.col("vsn"), F.lit(-1.0), F.lit(1.0), F.lit(0.5), half, half, "model_comment_pc1").orderBy("time_idx").collect()
    want = {"residual_ratio": [0.5, 1.0], "att_kl": [0.08228288, 0.19274476], "vsn_js": [0.00505939, 0.10174923], "vsn_rank_shift": [0.0, 2.0]}
    for name, values in want.items():
        assert [r[f"model_comment_pc1_{name}"] for r in out] == pytest.approx(values, abs=1e-7)


T = detect.Thresholds(models=("comment_pc1", "post_pc2"), collective_rows=4, collective_least=2, drift_rows=6, drift_least=4, drift_lag=3)


def _frame(spark, rows=24):
    start = dt.datetime(2025, 1, 1)
    data = []
    for i in range(rows):
        point = [100.0 if i == 20 and k < 4 else 0.01 * i / (rows - 1) for k in range(len(T.point_columns()))]
        data.append(("a", i, start + dt.timedelta(minutes=15 * i), *point, *[0.0] * len(T.level_columns())))
    cols = ["series string", "time_idx int", "timestamp timestamp_ntz", *(f"{c} double" for c in [*T.point_columns(), *T.level_columns()])]
    return spark.createDataFrame(data, ", ".join(cols))


def test_point_needs_four_votes(spark):
    f = _frame(spark)
    params = detect.calibrate(f.where("time_idx < 12"), ["series"], T)
    assert params.first()[f"point:{T.point_columns()[0]}"] == pytest.approx(0.01022945929, abs=1e-9)
    got = {r["time_idx"]: r for r in detect.predict(f, params, ["series"], "time_idx", "timestamp", T).collect()}
    assert got[20]["pred_label"] == "PA" and got[20]["point_trigger_count"] == 4
    assert got[20]["dominant_model"] == "comment_pc1" and got[20]["dominant_signal"] == "residual_ratio"
    assert got[20]["trigger_features"].split("|") == T.point_columns()[:4]


def test_missing_column_raises(spark):
    f = _frame(spark)
    with pytest.raises(ValueError):
        detect.calibrate(f.drop(T.point_columns()[0]), ["series"], T)


def test_drift_and_collective_transitions():
    s, action, start = ad.observe(dict(ad.START), ad.Batch(100, 1, 0, True), ad.Limits(retrace=12))
    assert (action, start, s["state"]) == ("FINETUNE_FROM_HISTORY", 88, "SWITCHING")
    k = ad.Limits(confirm=2, accumulate=3)
    s, action, _ = ad.observe(dict(ad.START), ad.Batch(10, 1, 1, False), k)
    assert s["state"] == "CA_TENTATIVE"
    s, action, _ = ad.observe(s, ad.Batch(11, 1, 1, False), k)
    assert action == "START_FORWARD_COLLECTION"
    s, action, _ = ad.observe(s, ad.Batch(14, 3, 0, False), k)
    assert action == "FINETUNE_FROM_FORWARD_DATA" and s["track"] == "collective"


def test_parallel_verdicts():
    k = ad.Limits(parallel=2, extension=4)
    s = {**ad.START, "state": "SWITCHING", "track": "drift"}
    t, action, _ = ad.judge(s, ["N", "N"], ["N", "N"], 50, k)
    assert action == "ACCEPT_NEW_BASELINE" and t["version"] == 1 and t["until"] == 50 + k.cooldown
    t, action, _ = ad.judge(s, ["CA"] * 2, ["CA"] * 2, 50, k)
    assert action == "EXTEND_PARALLEL_VALIDATION"
    t, action, _ = ad.judge(t, ["CA"] * 2, ["CA"] * 2, 52, k)
    assert action == "NONE"
    t, action, _ = ad.judge(t, ["CA"] * 2, ["CA"] * 2, 54, k)
    assert action == "REJECT_NEW_BASELINE"
    c = {**ad.START, "state": "SWITCHING", "track": "collective"}
    assert ad.judge(c, ["N", "N"], ["N", "CA"], 9, k)[1] == "REJECT_NEW_BASELINE"
    with pytest.raises(RuntimeError):
        ad.judge(dict(ad.START), ["N"], ["N"], 1)


def test_stream_equals_batch(spark, data):
    from tests.compare import rows_of
    from tidemark.plans import detection

    assert rows_of(detection.state_machine_batch(spark, data)) == rows_of(detection.stream_state_machine(spark, data))


def test_controller_equals_recursion_in_sql(spark, tmp_path):
    """Random batches with short limits pass through every action; the twin's recursion gives the same transitions."""
    import random

    import duckdb

    from tests.compare import rows_of, sql_rows
    from tidemark.plans.detection import machine_sql

    r = random.Random(2)
    k = ad.Limits(confirm=12, retrace=20, accumulate=30, parallel=16, extension=24, recovery=0.6, stability=0.7, cooldown=40, warmup=12)
    rows = []
    for series in range(12):
        mood = 0.1
        for i in range(150):
            mood = r.choice((0.0, 0.1, 0.5, 0.9)) if r.random() < 0.15 else mood
            n = r.randint(4, 8)
            ca = [sum(r.random() < m for _ in range(n)) for m in (mood, mood * r.random())]
            calm = [r.randint(0, n - c) if r.random() < 0.5 else n - c for c in ca]
            warm = [r.randint(c, n - a) for c, a in zip(calm, ca)]
            drift = [r.random() < 0.03, r.random() < 0.03]
            rows.append((f"s{series}", 8 * i + 7, n, ca[0], drift[0], calm[0], warm[0], ca[1], drift[1], calm[1], warm[1]))
    cols = "series string, at bigint, rows bigint, " + ", ".join(f"collective{i} bigint, drift{i} boolean, calm{i} bigint, warm{i} bigint" for i in (0, 1))
    df = spark.createDataFrame(rows, cols)
    df.write.parquet(str(tmp_path / "b"))
    batches = f"SELECT series, \"at\" AS moment, \"rows\" AS n_rows, {', '.join(f'collective{i} AS ca{i}, drift{i}, calm{i}, warm{i}' for i in (0, 1))} FROM '{tmp_path}/b/*.parquet'"
    got, want = rows_of(ad.fold(df, k)), sql_rows(duckdb.connect(), machine_sql(batches, k))
    assert got == want
    assert {x[0] for x in got[1]} == {"NONE", "START_FORWARD_COLLECTION", "FINETUNE_FROM_HISTORY", "FINETUNE_FROM_FORWARD_DATA", "EXTEND_PARALLEL_VALIDATION", "ACCEPT_NEW_BASELINE", "REJECT_NEW_BASELINE"}
