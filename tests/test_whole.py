"""Queries over small tables of their own, against brute force: nothing that the job covers is left out."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.functions import mathx
from tidemark.operators import models as md
from tidemark.plans import detection, features, models


def test_deviation_signals_keep_every_account(spark, tmp_path):
    """Accounts without windows in early 2025 have signals too, against the first quarter of their own windows."""
    cols = [*detection._POST, *detection._COMMENT]
    rng = np.random.default_rng(5)
    rows = []
    for uid, first in (("1", dt.datetime(2025, 2, 1)), ("2", dt.datetime(2025, 9, 1)), (None, dt.datetime(2025, 9, 1))):
        rows += [(f"{uid}-{i}", uid, first + dt.timedelta(days=i), *map(float, rng.uniform(0.1, 1, len(cols)))) for i in range(9)]
    rows.append(("3-0", "3", dt.datetime(2025, 10, 1), *[None] * len(cols)))
    spark.createDataFrame(rows, "window_id string, official_uid string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in cols)).write.parquet(f"{tmp_path}/features_19.parquet")
    got = {r["window_id"]: r for r in detection.deviation_signals(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    neg = 3 + cols.index("neg_ratio_post")
    for uid in ("1", "2"):
        own = [r for r in rows if r[1] == uid]
        quiet = np.array([r[neg] for r in own[:2]])  # ranks 0 and 1/8
        scale = max(*np.abs(np.quantile(quiet, [0.05, 0.95])), 1.645 * quiet.std())
        am = np.mean([r[3 : 3 + len(detection._POST)] for r in own[:2]], axis=0)
        for r in own:
            assert got[r[0]]["residual_ratio"] == pytest.approx(min(20, abs(r[neg]) / scale), abs=1e-6)
            p, q = np.array(r[3 : 3 + len(detection._POST)]), am
            p, q = p / p.sum(), q / q.sum()
            assert got[r[0]]["att_kl"] == pytest.approx((p * np.log(p / q)).sum(), abs=1e-6)
    assert all(got[f"None-{i}"]["residual_ratio"] is None and got[f"None-{i}"]["vsn_js"] is None for i in range(9))
    assert got["3-0"]["residual_ratio"] is None and got["3-0"]["att_kl"] == 0


_DOCS = [("a", "Café café crème 砂水怀表 と カタカナ"), ("a", "naïve ABC x 7 好看好看"), ("b", "砂水怀表"), ("b", "plain words words สวัสดี 고래야 안녕 שלום"), (None, "élan 砂水"), ("b", None), ("c", "")]


def _words(text):
    """Words of two letters or more of any scripts, of kana by themselves, and pairs of ideographs."""
    words = regex.findall(r"(?V1)[\p{Hiragana}\p{Katakana}ー]{2,}|[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]{2,}", text.lower())
    return words + [h[i : i + 2] for h in regex.findall(r"\p{Han}{2,}", text) for i in range(len(h) - 1)]


def test_words_of_every_script_are_counted(spark, tmp_path):
    spark.createDataFrame(_DOCS, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(w for _, t in _DOCS if t for w in _words(t))
    assert want["café"] == 2 and want["砂水"] == 3 and want["カタカナ"] == want["สวัสดี"] == want["고래야"] == 1
    assert {r["word"]: r["n"] for r in models.vocab_frequency(spark, str(tmp_path)).collect()} == want

    tf = Counter((s or "", w) for s, t in _DOCS if t for w in _words(t))
    mean = sum(tf.values()) / len({s for s, _ in tf})
    top = set()
    for cls in {s for s, _ in tf}:
        raw = {w: n * math.log(1 + mean / (want[w] + 1)) for (s, w), n in tf.items() if s == cls}
        ranked = sorted(raw.values(), reverse=True)
        top |= {(cls, i + 1, round(v / sum(ranked), 6)) for i, v in enumerate(ranked[:5]) if v >= 0.1 * ranked[0]}
    assert {tuple(r) for r in models.ctfidf_top_words(spark, str(tmp_path)).collect()} == top


@pytest.mark.parametrize("kind", ["normal", "student"])
def test_distance_of_fit_over_all_values(kind):
    """The distance is the largest over all values, not over 200 of them."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(3000) if kind == "normal" else rng.standard_t(4, 3000)
    fit = md.fit_marginal(x)
    cdf = (lambda v: float(mathx.norm_cdf(v))) if fit["df"] == 0 else (lambda v: mathx.t_cdf(v, fit["df"]))
    f = [cdf((v - fit["loc"]) / fit["scale"]) for v in np.sort(x)]
    d = max(max((i + 1) / len(x) - c, c - i / len(x)) for i, c in enumerate(f))
    assert fit["kind"] == kind and fit["ks"] == pytest.approx(d, abs=1e-9)
    assert fit["p"] == pytest.approx(mathx.ks_pvalue(d, len(x)), abs=1e-6)


def test_t_cdf_of_many_values():
    for df in (2.5, 3.0, 7.3, 60.0):
        x = np.array([-1e4, -80.0, -3.0, -0.2, 0.0, 1e-9, 0.7, 5.0, 300.0])
        assert mathx.t_cdf_all(x, df) == pytest.approx([mathx.t_cdf(v, df) for v in x], abs=1e-8)


def test_pages_and_counts_keep_every_row(spark, tmp_path):
    texts = [' "quoted" ', "<b>1 < 2 & 3 > 2</b>", "&lt;&amp;nbsp;", "it's", "line\n", '<div class="card-wrap" mid="9">', "  ", None]
    counts = ["12", " 7 ", "1.2e3", "1.2万", "转发", "1_0", None, "3.0"]
    cols = "post_id text author_id author_name post_type source_post_id source_author_name image_urls video_cover_url created_at client_tz reposts_count".split()
    rows = [{**dict.fromkeys(cols), "post_id": str(i), "text": t, "author_name": 'a"<&', "reposts_count": c} for i, (t, c) in enumerate(zip(texts, counts))]
    spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols)).withColumn("crawled_at", F.current_timestamp()).write.parquet(f"{tmp_path}/merged_post.parquet")
    got = {r["post_id"]: (r["author_name"], r["text"]) for r in models.html_card_extract(spark, str(tmp_path)).collect()}
    assert got == {r["post_id"]: (r["author_name"], (r["text"] or "").strip(" ") or None) for r in rows}
    got = {r["post_id"]: (r["reposts_count"], r["reposts"]) for r in features.counts_as_numbers(spark, str(tmp_path)).collect()}
    assert got == {str(i): (c, {"12": 12, " 7 ": 7}.get(c)) for i, c in enumerate(counts)}
