"""Golden values and properties of single operators."""

import datetime as dt
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import mathx, transforms, vectors
from tidemark.operators import features, lifecycle, models, robust, text, topics, visual, windows


def one(spark, col, value, schema="x double"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


@pytest.mark.parametrize("counts,want", [([10, 1], 0.4090909091), ([1] * 5, 0.0), ([10], 1.0), ([9], 0.0), ([1, 1, 1], 0.0), ([1, 2, 3, 4, 10], 0.4)])
def test_gini(spark, counts, want):
    df = spark.createDataFrame([(0, f"u{i}", n) for i, n in enumerate(counts)], "w int, u string, n int")
    assert features.gini(df, ["w"], "n").first()["gini"] == pytest.approx(want, abs=1e-9)


def test_small_text_functions(spark):
    assert one(spark, text.symbol_intensity(F.col("x")), "真的假的？！!!❗🕯️", "x string") == 5
    assert one(spark, text.parse_date(F.col("x")), "Mon Sep 29 13:02:14 +0800 2025", "x string") == dt.datetime(2025, 9, 29, 13, 2, 14)
    assert one(spark, text.sentences(F.col("x"), 1), "你好。真的吗？是", "x string") == ["你好。", "真的吗？", "是"]
    assert one(spark, text.length_class(F.col("x")), None, "x string") is None
    assert one(spark, text.tokens(F.col("x")), "鲸歌云 the Sea", "x string") == ["the", "sea", "鲸歌", "歌云"]


def test_negative_and_retweet_ratio(spark):
    df = spark.createDataFrame([(s,) for s in (0.1, 0.2, 0.5, 0.6, 0.9)], "s double")
    assert df.agg(features.negative_ratio(F.col("s")).alias("r")).first()["r"] == pytest.approx(0.2125)
    assert df.where("false").agg(features.negative_ratio(F.col("s")).alias("r")).first()["r"] == pytest.approx(0.15)


def test_compression_streams_like_one_call(spark):
    lines = [f"复刻名单写着第{i}件" for i in range(200)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(lines)] + [("b", 0, "short"), ("c", 0, None)], "g string, i int, t string")
    got = {r["g"]: r["comp_ratio"] for r in text.compression_ratio(df, ["g"], "t", ["i"]).collect()}
    raw = "\n".join(lines).encode()
    assert got == {"a": pytest.approx(len(zlib.compress(raw)) / len(raw)), "b": 1.0}


def test_transforms_round_trip(spark):
    for lam in (0.0, 0.5, 1.0, 2.0):
        for v in (-3.2, 0.0, 4.1):
            y = one(spark, transforms.yeo_johnson_inverse(transforms.yeo_johnson(F.col("x"), lam), lam), v)
            assert y == pytest.approx(v, abs=1e-9)
    assert one(spark, transforms.safe_logit(F.col("x")), None) == pytest.approx(0.0)
    assert one(spark, transforms.clean(F.col("x")), float("nan")) is None
    assert one(spark, transforms.clip(F.col("x"), -1, 1), None) is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], None)], "a array<double>, b array<double>, n array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("n")).alias("n"), vectors.js(vectors.probability(F.col("a")), vectors.probability(F.col("b"))).alias("j"), vectors.ordinal_ranks(F.array(F.lit(2.0), F.lit(5.0), F.lit(2.0))).alias("k")).first()
    assert r["c"] == 0 and r["n"] is None and r["j"] == pytest.approx(math.log(2), abs=1e-6) and r["k"] == [1.0, 0.0, 2.0]
    h = spark.createDataFrame([("0" * 63 + "1", "f" + "0" * 63)], "a string, b string")
    assert h.select(vectors.hamming_hex(F.col("a"), F.col("b")).alias("d")).first()["d"] == 5


def test_as_of_takes_the_event_of_the_slot(spark):
    t = lambda h, m=0: dt.datetime(2025, 1, 1, h, m)
    slots = spark.createDataFrame([("a", t(10)), ("a", t(10, 15)), ("a", t(10, 30)), ("b", t(9))], "k string, ts timestamp_ntz")
    events = spark.createDataFrame([("a", t(10, 30), "crisis"), ("a", t(10), "promotion")], "k string, ts timestamp_ntz, category string")
    got = {(r["k"], r["ts"]): r["category"] for r in windows.as_of(slots, events, ["k"], "ts", ["category"]).collect()}
    assert got == {("a", t(10)): "promotion", ("a", t(10, 15)): "promotion", ("a", t(10, 30)): "crisis", ("b", t(9)): None}


def test_lookback_is_open_on_the_left(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 10, m)
    p = spark.createDataFrame([(m, t(m)) for m in (0, 1, 15, 16)], "i int, ts timestamp_ntz")
    a = spark.createDataFrame([(t(15),)], "at timestamp_ntz")
    assert sorted(r["i"] for r in windows.lookback_pairs(p, a, "ts", "at", 900).collect()) == [1, 15]
    assert sorted(r["i"] for r in lifecycle.in_any_window(p, a.union(a), "ts", "at").collect()) == [1, 15]


def test_segments_split_at_labels_and_gaps(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 10) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("a", t(0), "N"), ("a", t(15), "N"), ("a", t(30), "PA"), ("a", t(45), "PA"), ("a", t(90), "PA"), ("a", t(105), "N")], "s string, ts timestamp_ntz, label string")
    got = sorted((r["segment"], r["n"]) for r in lifecycle.segments(df, ["s"], "ts", "label").collect())
    assert got == [(2, 2), (3, 1)]


def test_near_hashes_are_found_by_bands(spark):
    base = int("0123456789abcdef" * 4, 16)
    rng = np.random.default_rng(1)
    flip = lambda n: format(base ^ sum(1 << int(b) for b in rng.choice(256, n, replace=False)), "064x")
    hashes = [format(base, "064x"), *(flip(10) for _ in range(20)), *(flip(40) for _ in range(5))]
    df = spark.createDataFrame([(0, h) for h in hashes] + [(0, None)], "w int, h string")
    want = {(a, b) for a in hashes for b in hashes if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 10}
    assert {(r["a"], r["b"]) for r in visual.hash_links(df, "w", "h").collect()} == want


def test_perceptual_hash(spark):
    rng = np.random.default_rng(2)
    image = np.kron(rng.uniform(0, 255, (30, 40)), np.ones((4, 4)))  # texture at all scales that the hash looks at
    near = [image + rng.normal(0, 4, image.shape), image * 0.8 + 20, np.kron(image, np.ones((2, 2)))]
    far = [rng.uniform(0, 255, (90, 90)), image.T, np.kron(rng.uniform(0, 255, (30, 40)), np.ones((4, 4)))]
    bits = lambda a, b: bin(int(visual.perceptual_hash(a), 16) ^ int(visual.perceptual_hash(b), 16)).count("1")
    assert all(bits(image, o) <= 10 for o in near) and all(bits(image, o) > 70 for o in far)
    decode = lambda b: np.frombuffer(b, np.uint8).reshape(16, 16)
    df = spark.createDataFrame([(1, bytes(range(256))), (2, None), (3, b"broken")], "i int, content binary")
    got = {r["i"]: r["h"] for r in visual.hash_images(df, "content", decode).collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] is None


def test_components_over_long_chains(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)] + [("z",)], "node string")
    got = {r["node"]: r["root"] for r in visual.components_global(links, nodes).collect()}
    assert set(got.values()) == {"n000", "z"} and got["n060"] == "n000"


def test_robust_and_kendall(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 2, 9, 0)], "feature string, value double")
    r = robust.robust_scale(df, ["feature"]).first()
    assert (r["median"], r["p95"]) == (2.0, pytest.approx(7.6)) and r["scale"] == pytest.approx(1.4826)
    m = robust.moments(df, ["feature"]).first()
    assert (m["skew"], m["kurtosis"]) == (pytest.approx(1.2939423257), pytest.approx(0.0039370079, abs=1e-6))
    x = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (3, 4), (None, 1)], "x int, y int")
    assert robust.kendall_tau(x, "x", "y").first()["tau"] == pytest.approx(3 / math.sqrt(5 * 6))


def test_fix_runs_and_empty(spark):
    df = spark.createDataFrame([("a", i, v, v > 50) for i, v in enumerate((1.0, 99.0, 99.0, 4.0, 99.0))], "k string, i int, x double, bad boolean")
    got = [r["fixed"] for r in robust.fix_runs(df, ["k"], "i", "x", "bad").orderBy("i").collect()]
    assert got == pytest.approx([1, 2, 3, 4, 4])
    assert robust.fix_runs(df.where("false"), ["k"], "i", "x", "bad").count() == 0


def test_series_models():
    rng = np.random.default_rng(0)
    x = models.ar_simulate(rng.standard_normal(4000), np.array([0.0, 0.6, 0.0]), (1, 2))
    beta, res = models.ar_fit(x, (1, 2))
    assert beta[1] == pytest.approx(0.6, abs=0.05) and models.ljung_box(res)[1] > 0.001
    h, e = 1.0, []
    for _ in range(3000):
        e.append(math.sqrt(h) * rng.standard_normal())
        h = 0.1 + 0.2 * e[-1] ** 2 + 0.7 * h
    g = models.garch_fit(np.array(e))
    assert 0.75 < g["persistence"] < 0.995
    c = models.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.linalg.eigvalsh(c).min() > 0 and np.allclose(np.diag(c), 1)
    t = np.arange(2000.0)
    y = 0.01 * t + 3 * np.sin(2 * math.pi * t / 96)
    assert models.decompose(t, y)[3] > 0.99
    assert models.decay_fit(5 * np.exp(-np.arange(32) / 6))["kind"] == "exp"
    assert models.fit_counts(rng.poisson(3, 2000).astype(float))["kind"] == "poisson"
    assert models.fit_counts(rng.negative_binomial(1, 0.2, 2000).astype(float))["kind"] == "negative_binomial"
    s = models.copula_sample(np.array([[1, 0.8], [0.8, 1]]), np.array([np.linspace(0, 1, 101), np.linspace(5, 9, 101)]), 4000, 1)
    assert np.corrcoef(s.T)[0, 1] == pytest.approx(0.79, abs=0.05) and s[:, 1].min() >= 5
    assert len(models.forecast(np.arange(5), np.ones(5), np.ones((5, 2)))) == 0


def test_distribution_functions():
    assert mathx.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert mathx.norm_ppf([1e-10])[0] == pytest.approx(-6.361340902, abs=1e-6)
    assert mathx.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert mathx.t_ppf(0.975, 5) == pytest.approx(2.570581836, abs=1e-6)
    assert float(mathx.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, [0, 0])[0]) == pytest.approx(3, abs=1e-3)


def test_topics(spark):
    df = spark.createDataFrame([("a", ["whale", "song", "song"]), ("b", ["ship", "song"])], "c string, t array<string>")
    w = topics.class_tf_idf(df, "c", F.col("t"))
    assert sum(r["weight"] for r in w.where("c = 'a'").collect()) == pytest.approx(1)
    assert topics.top_words(w, "c", 1).where("c = 'b'").first()["word"] == "ship"


def test_files(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_bytes("﻿的\n了\n".encode())
    (tmp_path / "w" / "b.txt").write_bytes("鲸\n了\n".encode("gbk"))
    assert sorted(r["word"] for r in files.read_words(spark, str(tmp_path / "w")).collect()) == sorted(["的", "了", "鲸"])
    df = spark.createDataFrame([(1, 'two\nlines "quoted"'), (2, None)], "i int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted((r["i"], r["t"]) for r in files.read_csv(spark, str(tmp_path / "c"), "i int, t string").collect())[0] == (1, 'two\nlines "quoted"')
    files.write_params(spark, str(tmp_path / "p"), {"k": 5.0, "名": [1, 2]})
    assert files.read_params(spark, str(tmp_path / "p")) == {"k": 5.0, "名": [1, 2]}
    (tmp_path / "lex.txt").write_text("鲸歌 n\n云旅\n")
    assert sorted((r["word"], r["tag"]) for r in files.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()) == [("云旅", None), ("鲸歌", "n")]


def test_inference_in_batches(spark):
    """The model sees batches of known rows, and each result goes to its own row."""

    def load():
        def score(texts, weights):
            assert 0 < len(texts) <= 3
            return [len(t) * w for t, w in zip(texts, weights)]

        return score

    df = spark.createDataFrame([(i, "x" * i if i != 4 else None, 0.5) for i in range(10)], "i int, t string, w double").coalesce(1)
    got = {r["i"]: r["s"] for r in models.infer(df, ["t", "w"], load, "double", "s", batch=3).collect()}
    assert got == {i: None if i == 4 else i * 0.5 for i in range(10)}
    assert models.infer(df.where("false"), ["t", "w"], load, "double", "s").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_percentiles_of_large_keys(spark, keys):
    """The way of large keys gives what one group gives: ties, one value, nulls and few buckets included."""
    rng = np.random.default_rng(6)
    values = {"ties": rng.integers(0, 7, 900).astype(float), "normal": rng.normal(0, 1, 1500), "one": np.array([4.25]), "same": np.full(300, 2.0), "two": np.array([1.0, 9.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {tuple(r[c] for c in keys): (r["n"], r["q"]) for r in robust.exact_percentiles(df, keys, "x", points, large=2, buckets=16).collect()}
    want = {(k,): x for k, x in values.items()} if keys else {(): np.concatenate(list(values.values()))}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k][0] == len(x) and got[k][1] == pytest.approx(np.quantile(x, points))


def test_nearest_within(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    left = [("a", i, at(s)) for i, s in enumerate((0, 100, 5_000, 86_400))] + [(None, 9, at(0)), ("a", 0, at(0))]
    right = [("a", 1, at(-50)), ("a", 2, at(50)), ("a", 3, at(50)), ("a", 4, at(5_060)), ("b", 5, at(86_400)), ("a", 6, None)]
    l, r = spark.createDataFrame(left, "k string, i int, ts timestamp_ntz"), spark.createDataFrame(right, "k string, j int, ts timestamp_ntz")
    got = sorted((x["i"], x["j"], x["distance_s"]) for x in windows.nearest_within(l, r, ["k"], "ts", "i", "j", 60).collect())
    assert got == [(0, 1, 50.0), (1, 2, 50.0), (2, 4, 60.0)]


def test_families_and_orders():
    """Each family and volatility form is chosen where the values come from it, with parameters near the true ones."""
    rng = np.random.default_rng(7)
    n = 3000
    drawn = {"normal": rng.normal(2, 3, n), "lognormal": rng.lognormal(0.5, 0.8, n), "pareto": 2 * (1 + rng.pareto(3, n)), "beta": rng.beta(2, 5, n), "mixture": np.concatenate([rng.normal(-3, 1, n // 3), rng.normal(4, 0.5, n)])}
    fits = {k: models.fit_family(x) for k, x in drawn.items()}
    assert {k: f["kind"] for k, f in fits.items()} == {k: k for k in drawn}
    assert fits["beta"]["params"] == pytest.approx([2, 5], rel=0.1) and fits["pareto"]["params"][1] == pytest.approx(3, rel=0.1)
    zero = np.where(rng.random(n) < 0.4, 0, rng.negative_binomial(3, 0.3, n)).astype(float)
    c = models.fit_counts(zero)
    assert c["kind"] == "zero_inflated" and c["zero"] == pytest.approx(0.38, abs=0.06) and c["mean"] == pytest.approx(7, abs=0.5)
    assert models.fit_family(np.ones(50))["kind"] == "point" and models.fit_family(np.array([]))["kind"] == "point"

    def simulate(kind, a, b, g, errors, n=2500):
        h, e, log_h = [1.0] * 2, [0.1, 0.1], 0.0
        for _ in range(n):
            z = rng.standard_normal() if errors == "normal" else rng.standard_t(4) / math.sqrt(2)
            if kind == "egarch":
                last = e[-1] * math.exp(-0.5 * log_h)
                log_h = a[0] * (abs(last) - math.sqrt(2 / math.pi)) + g * last + b[0] * log_h
                h.append(math.exp(log_h))
            else:
                h.append(0.1 + sum(w * e[-k] ** 2 for k, w in enumerate(a, 1)) + g * (e[-1] < 0) * e[-1] ** 2 + sum(w * h[-k] for k, w in enumerate(b, 1)))
            e.append(math.sqrt(h[-1]) * z)
        return np.array(e)

    heavy = models.garch_fit(simulate("garch", [0.15], [0.75], 0.0, "student"))
    assert heavy["errors"] == "student" and 0.75 < heavy["persistence"] <= 0.995
    sided = models.garch_fit(simulate("egarch", [0.2], [0.9], -0.25, "normal"), forms=(("garch", 1, 1), ("egarch", 1, 1)))
    assert sided["kind"] == "egarch" and sided["gamma"] < -0.1 and sided["beta"] == pytest.approx(0.9, abs=0.07)
    x = simulate("egarch", [0.2], [0.9], -0.25, "normal")
    assert len(models.fitted_variance(x, sided)) == len(x) and (models.fitted_variance(x, sided) > 0).all()
    second = models.garch_fit(simulate("garch", [0.05, 0.5], [0.2], 0.0, "normal"), forms=(("garch", 1, 1), ("garch", 2, 1)))
    assert len(second["alphas"]) == 2


def test_normality_partials_and_exponents():
    rng = np.random.default_rng(8)
    assert models.shapiro_francia(rng.standard_normal(500))[1] > 0.05 > 1e-4 > models.shapiro_francia(rng.exponential(1, 500))[1]
    ar = models.ar_simulate(rng.standard_normal(6000), np.array([0.0, 0.5, -0.4]), (1, 2))
    p = models.partial_autocorrelations(ar, 5)
    assert p[1] == pytest.approx(-0.4, abs=0.05) and np.abs(p[2:]).max() < 0.06
    assert models.fit_lambda(rng.lognormal(0, 1, 4000)) == pytest.approx(0, abs=0.05)
    assert models.fit_lambda((rng.normal(5, 0.5, 4000)) ** 2) == pytest.approx(0.5, abs=0.25)
    assert models.fit_lambda(rng.normal(0, 1, 4000), "yeo_johnson") == pytest.approx(1, abs=0.1)
    assert models.fit_lambda(np.ones(9)) == 1.0
