"""Runs by similarity of features: blocks of time change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import runs


def brute(rows, similarity, gap):
    out = set()
    for e in {r[0] for r in rows}:
        line = sorted({(r[2], r[1], r[3], r[4]) for r in rows if r[0] == e})
        head = runs.agglomerate([x[2] for x in line], [[x[3]] for x in line], [x[0] for x in line], [x[0] for x in line], [1] * len(line), [True] * len(line), similarity, gap)
        for h in set(head):
            own = [x for x, k in zip(line, head) if k == h]
            out.add((e, own[0][2], own[0][1], own[-1][1], len(own), round(sum(x[3] for x in own) / len(own), 6)))
    return out


@pytest.mark.parametrize("block", [3000, 50_000])
def test_similar_runs_equal_one_pass_over_the_line(spark, block):
    rng = random.Random(block)
    rows, t = [], 0.0
    for k in range(400):
        t += rng.choice([300, 900, 900, 900, 1800, 1801])
        rows.append(("hot" if k % 5 else "cold", k, t, rng.choice("NNNNNNNA"), rng.choice([0.0, 0.1, 0.2, 0.3, 0.45])))
    df = spark.createDataFrame(rows + rows[:20], "uid string, k bigint, s double, label string, x double")
    got = runs.collapse_runs(df, "uid", F.col("s"), "k", F.col("label"), 3600, min_similarity=0.8, features=[F.col("x")], block_seconds=block)
    assert {(r["entity"], r["label"], r["first_key"], r["last_key"], r["n"], round(r["features"][0], 6)) for r in got.collect()} == brute(rows, 0.8, 3600)
