"""Queries of series models, images, topics and page records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vec
from tidemark.operators import models as md
from tidemark.operators import robust as rb
from tidemark.operators import text as tx
from tidemark.operators import topics as tp
from tidemark.operators import visual as vs
from tidemark.operators import windows as wn
from tidemark.plans.common import OFFICIAL, POSTS, SLOT, WINDOWS, official, posts, r, windows
from tidemark.plans.features import _STRICT, _TOKENS
from tidemark.plans.statistics import COLS
from tidemark.sources.html import cards, escaped
from tidemark.sources.tables import table

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _grid(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """(official_uid, t, columns): one row for each account and 15-minute slot, missing values 0."""
    cols = columns or COLS
    t = F.floor(F.unix_timestamp("timestamp") / 900).cast("bigint")
    return windows(spark, d).groupBy("official_uid", t.alias("t")).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias(c) for c in cols))


# ---- series models


@query()
def pca_targets(spark: SparkSession, d: str) -> DataFrame:
    """ML3: two components of the robust z scores of each channel, centred, largest loading positive."""
    out = None
    for channel in ("post", "comment"):
        cols = [c for c in COLS if c.endswith(channel)]
        w = windows(spark, d)
        long = rb.melt(w, ["window_id"], cols)
        z = rb.robust_z(long, rb.robust_scale(long, ["feature"]), ["feature"])
        wide = z.groupBy("window_id").pivot("feature", cols).agg(F.first("z")).fillna(0.0)
        # covariances are sums: one aggregation, k x k numbers to the driver
        k = len(cols)
        sums = wide.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)).first()
        cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        _, v = np.linalg.eigh(cov)
        load = v[:, ::-1][:, :2]
        load = load * np.sign(load[np.abs(load).argmax(axis=0), range(2)])
        pcs = [sum(((F.col(c) - (sums[f"m{i}"] or 0.0)) * float(load[i, q]) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"pc{q + 1}") for q in range(2)]
        part = wide.select("window_id", F.lit(channel).alias("channel"), *pcs)
        out = part if out is None else out.unionByName(part)
    return out


@query()
def forecast_surrogate(spark: SparkSession, d: str) -> DataFrame:
    """ML10: the default forecaster for each account."""
    feats = [c for c in COLS if c != "total_volume_comment"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = md.forecast(pdf["t"].to_numpy(), pdf["total_volume_comment"].to_numpy(float), pdf[feats].to_numpy(float))
        out.insert(0, "official_uid", pdf["official_uid"].iloc[0])
        return out

    return md.per_series(_grid(spark, d), ["official_uid"], one, "official_uid string, time_idx bigint, target_true double, p10 double, p50 double, p90 double, residual double, divergence double, attention array<double>, vsn array<double>")


@query()
def forecast_signals(spark: SparkSession, d: str) -> DataFrame:
    """ML10 into DT1: the forecaster's outputs against each account's own first part."""
    from tidemark.operators import detect as dt
    from tidemark.operators.features import centroids
    from tidemark.session import materialize

    f = materialize(forecast_surrogate(spark, d), "forecast")
    quiet = f.withColumn("q", F.percent_rank().over(Window.partitionBy("official_uid").orderBy("time_idx"))).where("q < 0.25").drop("q")
    base = quiet.groupBy("official_uid").agg(F.percentile("residual", 0.05).alias("p5"), F.percentile("residual", 0.95).alias("p95"), F.stddev_pop("residual").alias("sd"))
    base = base.join(centroids(quiet, ["official_uid"], "attention").withColumnRenamed("centroid", "am"), "official_uid").join(centroids(quiet, ["official_uid"], "vsn").withColumnRenamed("centroid", "vm"), "official_uid")
    out = dt.deviation_signals(f.join(base, "official_uid"), F.col("residual"), F.col("attention"), F.col("vsn"), F.col("p5"), F.col("p95"), F.col("sd"), F.col("am"), F.col("vm"), "model")
    return out.select("official_uid", "time_idx", *(f"model_{s}" for s in dt.SIGNALS))


LAGS = (1, 2, 3, 4, 5)


@query()
def ar_ols(spark: SparkSession, d: str) -> DataFrame:
    """ML16, ML17: autoregression, and tests of what it leaves."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, res = md.ar_fit(md._series(pdf, "t", "total_volume_comment"), LAGS)
        lb, arch, jb, sf = md.ljung_box(res), md.arch_lm(res), md.jarque_bera(res), md.shapiro_francia(res)
        return pd.DataFrame([[pdf["official_uid"].iloc[0], list(map(float, beta)), float(np.std(res)), lb[0], lb[1], arch[0], arch[1], jb[0], jb[1], sf[0], sf[1], md.partial_autocorrelations(md._series(pdf, "t", "total_volume_comment"), 10).tolist()]], columns=["official_uid", "beta", "sigma", "ljung_box", "p_ljung_box", "arch", "p_arch", "jarque_bera", "p_jarque_bera", "shapiro", "p_shapiro", "pacf"])

    return md.per_series(_grid(spark, d), ["official_uid"], one, "official_uid string, beta array<double>, sigma double, ljung_box double, p_ljung_box double, arch double, p_arch double, jarque_bera double, p_jarque_bera double, shapiro double, p_shapiro double, pacf array<double>")


@query()
def garch_fold(spark: SparkSession, d: str) -> DataFrame:
    """ML18, ML19: volatility model of each account's residuals, with the band it gives."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, res = md.ar_fit(md._series(pdf, "t", "total_volume_comment"), LAGS)
        g = md.garch_fit(res)
        h = md.fitted_variance(res, g) if len(res) else np.zeros(1)
        return pd.DataFrame([[pdf["official_uid"].iloc[0], g["kind"], g["errors"], len(g["alphas"]), len(g["betas"]), g["omega"], g["alpha"], g["beta"], g["gamma"], g["persistence"], float(np.sqrt(h).mean()), 1.96 * float(np.sqrt(h[-1]))]], columns=["official_uid", "kind", "errors", "shock_lags", "variance_lags", "omega", "alpha", "beta", "gamma", "persistence", "mean_volatility", "band"])

    return md.per_series(_grid(spark, d), ["official_uid"], one, "official_uid string, kind string, errors string, shock_lags int, variance_lags int, omega double, alpha double, beta double, gamma double, persistence double, mean_volatility double, band double")


@query()
def ar_recursion(spark: SparkSession, d: str) -> DataFrame:
    """ML24 to ML27: seeded volatility blocks times normal shocks through the autoregression."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        beta, res = md.ar_fit(md._series(pdf, "t", "total_volume_comment"), LAGS)
        g = md.garch_fit(res)
        h = md.fitted_variance(res, g) if len(res) else np.zeros(1)
        seed = int(pdf["official_uid"].iloc[0]) % (1 << 31)
        shocks = np.sqrt(md.block_bootstrap(h, len(pdf), seed)) * np.random.default_rng(seed).standard_normal(len(pdf))
        return pd.DataFrame({"official_uid": pdf["official_uid"].iloc[0], "t": pdf["t"].to_numpy(), "synthetic": np.maximum(0.0, md.ar_simulate(shocks, beta, LAGS))})

    return md.per_series(_grid(spark, d), ["official_uid"], one, "official_uid string, t bigint, synthetic double")


@query()
def decompose_series(spark: SparkSession, d: str) -> DataFrame:
    """ML14: trend, season and rest."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        tr, se, res, r2 = md.decompose(pdf["t"].to_numpy(float), pdf["total_volume_comment"].to_numpy(float))
        return pd.DataFrame({"official_uid": pdf["official_uid"].iloc[0], "t": pdf["t"].to_numpy(), "trend": tr, "seasonal": se, "residual": res, "r2": r2})

    return md.per_series(_grid(spark, d), ["official_uid"], one, "official_uid string, t bigint, trend double, seasonal double, residual double, r2 double")


@query()
def distribution_fits(spark: SparkSession, d: str) -> DataFrame:
    """ML13, ML22: the distribution of each feature of each account."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        f = pdf["feature"].iloc[0]
        m, c, y = md.fit_marginal(x), md.fit_counts(x) if f.startswith("total") else {"kind": "", "mean": 0.0, "size": 0.0, "zero": 0.0}, md.fit_family(x)
        return pd.DataFrame([[pdf["official_uid"].iloc[0], f, m["kind"], m["loc"], m["scale"], m["df"], m["ks"], m["p"], c["kind"], c["mean"], c["size"], c["zero"], y["kind"], y["params"]]], columns=["official_uid", "feature", "kind", "loc", "scale", "df", "ks", "p", "counts", "mean", "size", "zero", "family", "params"])

    long = rb.melt(windows(spark, d), ["official_uid"], COLS)
    return md.per_series(long, ["official_uid", "feature"], one, "official_uid string, feature string, kind string, loc double, scale double, df double, ks double, p double, counts string, mean double, size double, zero double, family string, params array<double>")


@query()
def copula_sample(spark: SparkSession, d: str) -> DataFrame:
    """ML23: synthetic windows with the correlations and marginals of all accounts together, by seeded blocks of rows."""
    w = windows(spark, d)
    corr = {(x["a"], x["b"]): x["r"] for x in rb.correlations(w, COLS).collect()}  # k x k numbers
    c = np.array([[1.0 if a == b else corr.get((a, b), corr.get((b, a))) or 0.0 for b in COLS] for a in COLS])
    prof = {x["feature"]: x["profile"] for x in rb.percentile_profile(rb.melt(w, [], COLS), ["feature"]).collect()}
    p = np.array([prof[k] for k in COLS])
    n = w.count()
    rows = 10_000

    def block(it):
        for pdf in it:
            for b in pdf["id"]:
                k = min(rows, n - b * rows)
                out = pd.DataFrame(md.copula_sample(c, p, k, 42 + int(b)), columns=COLS)
                out.insert(0, "row", np.arange(k) + b * rows)
                yield out

    return spark.range(-(-n // rows)).mapInPandas(block, "row bigint, " + ", ".join(f"{x} double" for x in COLS))


@query()
def decay_indicators(spark: SparkSession, d: str) -> DataFrame:
    """ML15: exponential or power decay of the response to each class of official posts."""
    from tidemark.plans.statistics import event_response_curve

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = md.decay_fit(pdf.sort_values("k")["mean"].to_numpy(float))
        return pd.DataFrame([[pdf["category"].iloc[0], f["kind"], f["amplitude"], f["rate"], f["r2"]]], columns=["category", "kind", "amplitude", "rate", "r2"])

    return event_response_curve(spark, d).groupBy("category").applyInPandas(one, "category string, kind string, amplitude double, rate double, r2 double")


# ---- images


def _images(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).where("ts IS NOT NULL AND image_urls IS NOT NULL")
    e = p.select(wn.slot(F.col("ts"), "1 day").alias("w"), F.explode(F.split("image_urls", ", ")).alias("u")).where("u <> ''")
    return e.select("w", vs.planted_hash(F.col("u")).alias("h"))


def _planted_sql(u: str, digits: int = 1) -> str:
    base, own = f"sha256(substr(md5({u}), 1, {digits}))", lambda k: f"substr(md5({u}), {digits + k}, 1)"
    return f"substr({base}, 1, 20) || {own(1)} || substr({base}, 22, 20) || {own(2)} || substr({base}, 43, 21) || {own(3)}"


_DIFFER = " + ".join(f"CAST(bit_count(xor(CAST('0x' || substr(x.h, {i}, 15) AS BIGINT), CAST('0x' || substr(y.h, {i}, 15) AS BIGINT))) AS INT)" for i in (1, 16, 31, 46)) + " + CAST(bit_count(xor(CAST('0x' || substr(x.h, 61) AS BIGINT), CAST('0x' || substr(y.h, 61) AS BIGINT))) AS INT)"
# clusters by brute force: all pairs of a day's hashes, then all that can be reached
_IMAGES = f"{POSTS}, img AS (SELECT time_bucket(INTERVAL '1 day', ts) AS w, {_planted_sql('u')} AS h FROM (SELECT ts, unnest(string_split(image_urls, ', ')) AS u FROM posts WHERE ts IS NOT NULL AND image_urls IS NOT NULL) WHERE u <> ''), per AS (SELECT w, h, count(*) AS m FROM img GROUP BY ALL), near AS MATERIALIZED (SELECT x.w, x.h AS a, y.h AS b FROM per x JOIN per y ON x.w = y.w WHERE x.h = y.h OR {_DIFFER} <= 10), reach AS (SELECT w, a, b FROM near UNION SELECT r.w, r.a, n.b FROM reach r JOIN near n ON r.w = n.w AND r.b = n.a), roots AS (SELECT w, a AS h, min(b) AS root FROM reach GROUP BY w, a), size AS (SELECT w, root, sum(m) AS m FROM per JOIN roots USING (w, h) GROUP BY w, root), c AS (SELECT w, root AS h, m, row_number() OVER (PARTITION BY w ORDER BY m DESC, root) AS k FROM size)"


@query(f"WITH RECURSIVE {_IMAGES} SELECT w, CAST(sum(m) AS BIGINT) AS n, count(*) AS groups, CAST(sum(m) - count(*) AS BIGINT) AS redundancy, round(sum(m) FILTER (k <= 3) / (sum(m) + 15), 6) AS concentration, CAST(max(m) AS BIGINT) AS largest FROM c GROUP BY w")
def image_repetition(spark: SparkSession, d: str) -> DataFrame:
    """AG12, AG13, J14, ML39: planted hashes of links stand for those of images; near ones form clusters."""
    return vs.repetition(_images(spark, d), "w", "h").withColumn("concentration", r(F.col("concentration")))


@query(f"WITH RECURSIVE {_IMAGES}, g AS (SELECT w, sum(m) AS n, sum(m) - count(*) AS red, max(m) AS largest FROM c GROUP BY w) SELECT w, round(least(100.0, red * (1 + largest / n)), 6) AS impact, CAST(red - lag(red) OVER (ORDER BY w) AS DOUBLE) AS change, round(red / greatest(coalesce(avg(red) OVER (ORDER BY w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 1), 1), 6) AS burst, CAST(sum(CAST(red > 0 AS INT)) OVER (ORDER BY w ROWS 2 PRECEDING) AS BIGINT) AS sustained FROM g")
def impact_score(spark: SparkSession, d: str) -> DataFrame:
    """SF39, WN11, PF20: a row for each day, so one line of windows is short."""
    g = vs.repetition(_images(spark, d), "w", "h").withColumn("all_", F.lit(0))
    o = Window.partitionBy("all_").orderBy("w")
    red = F.col("redundancy")
    before = F.greatest(F.coalesce(F.avg(red).over(o.rowsBetween(-4, -1)), F.lit(1.0)), F.lit(1.0))
    return g.select("w", r(vs.impact_score(red, F.col("largest"), F.col("n"))).alias("impact"), r((red - F.lag(red).over(o)).cast("double")).alias("change"), r(red / before).alias("burst"), F.sum((red > 0).cast("int")).over(o.rowsBetween(-2, 0)).alias("sustained"))


@query(
    f"WITH RECURSIVE docs AS (SELECT doc_id, {_planted_sql('text', 3)} AS h FROM documents WHERE text IS NOT NULL AND text <> ''), per AS (SELECT 0 AS w, h FROM docs GROUP BY h), base AS (SELECT *, substr(h, 1, 20) AS p FROM per), near AS MATERIALIZED (SELECT x.h AS a, y.h AS b FROM base x JOIN base y ON x.p = y.p WHERE {_DIFFER} <= 10), "
    "lab AS (SELECT h, h AS root, 0 AS i, true AS moved FROM per UNION ALL SELECT h, root, i, moved FROM (SELECT l.h, min(o.root) AS root, l.i + 1 AS i, bool_or(min(o.root) < l.root) OVER () AS moved FROM lab l JOIN near n ON l.h = n.a JOIN lab o ON o.h = n.b GROUP BY l.h, l.root, l.i) WHERE moved), "
    "last AS (SELECT h, min(root) AS root FROM lab GROUP BY h) SELECT min(doc_id) AS first_doc, count(*) AS n FROM docs JOIN last USING (h) GROUP BY root"
)
def hash_clusters(spark: SparkSession, d: str) -> DataFrame:
    """ML39 without windows: documents whose planted hashes of 256 bits are near, components over all."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select(F.lit(0).alias("w"), vs.planted_hash(F.col("text"), 3).alias("h"), "doc_id")
    links = vs.hash_links(docs, "w", "h")
    nodes = docs.select(F.col("h").alias("node")).distinct()
    c = vs.components_global(links, nodes)
    return docs.join(c, docs["h"] == c["node"]).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).select("first_doc", "n")


@query("SELECT source, count(*) AS n, round(1 - count(DISTINCT text) / nullif(count(text), 0), 6) AS repetition FROM documents GROUP BY 1")
def exact_repetition(spark: SparkSession, d: str) -> DataFrame:
    """AG13."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(1 - F.count_distinct("text") / F.nullif(F.count("text"), F.lit(0))).alias("repetition"))


# ---- topics

# words of any script but ideographs and kana, runs of kana, pairs of ideographs
_KANA = "\\p{Hiragana}\\p{Katakana}ー"
_WORDS = (
    f"docs AS (SELECT coalesce(source, '') AS source, text, lower(text) AS low FROM documents WHERE text IS NOT NULL), runs AS (SELECT source, unnest(regexp_extract_all(text, '\\p{{Han}}{{2,}}')) AS h FROM docs), "
    f"words AS (SELECT source, unnest(regexp_extract_all(regexp_replace(low, '[\\p{{Han}}{_KANA}]', ' ', 'g'), '[\\p{{L}}\\p{{M}}]{{2,}}')) AS word FROM docs UNION ALL SELECT source, unnest(regexp_extract_all(low, '[{_KANA}]{{2,}}')) FROM docs "
    f"UNION ALL SELECT source, substr(h, i, 2) FROM (SELECT source, h, unnest(generate_series(1, length(h) - 1)) AS i FROM runs))"
)


@query(f"WITH {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1")
def vocab_frequency(spark: SparkSession, d: str) -> DataFrame:
    """ML38, over words of every script and pairs of ideographs."""
    return tp.vocabulary(table(spark, d, "documents").where("text IS NOT NULL"), tx.tokens(F.col("text"), other_scripts=True))


@query(f"WITH {_WORDS}, t AS (SELECT source, word, count(*) AS n FROM words GROUP BY ALL), a AS (SELECT word, sum(n) AS all_n FROM t GROUP BY 1), m AS (SELECT sum(n) / count(DISTINCT source) AS a FROM t), r AS (SELECT t.*, n * ln(1 + m.a / (all_n + 1)) AS w FROM t JOIN a USING (word), m), k AS (SELECT source, word, w / sum(w) OVER (PARTITION BY source) AS weight FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, word) AS rank, max(weight) OVER (PARTITION BY source) AS best FROM k) SELECT source, rank, round(weight, 6) AS weight FROM o WHERE rank <= 5 AND weight >= 0.1 * best")
def ctfidf_top_words(spark: SparkSession, d: str) -> DataFrame:
    """ML35, ST3, over words of every script and pairs of ideographs."""
    df = table(spark, d, "documents").where("text IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("")))
    return tp.top_words(tp.class_tf_idf(df, "source", tx.tokens(F.col("text"), other_scripts=True)), "source").select("source", "rank", r(F.col("weight")).alias("weight"))


_TFIDF = "t AS (SELECT {cls}, word, count(*) AS n FROM words GROUP BY ALL), a AS (SELECT word, sum(n) AS all_n FROM t GROUP BY 1), m AS (SELECT sum(n) / count(DISTINCT {cls}) AS a FROM t), r AS (SELECT t.*, n * ln(1 + m.a / (all_n + 1)) AS w FROM t JOIN a USING (word), m), k AS (SELECT {cls}, word, w / sum(w) OVER (PARTITION BY {cls}) AS weight FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY weight DESC, word) AS rank, max(weight) OVER (PARTITION BY {cls}) AS best FROM k)"


@query(f"WITH {POSTS}, words AS (SELECT post_type, unnest({_TOKENS.format(_STRICT.format('text'))}) AS word FROM posts WHERE text IS NOT NULL), {_TFIDF.format(cls='post_type')} SELECT post_type, rank, word, round(weight, 8) AS weight FROM o WHERE rank <= 5 AND weight >= 0.1 * best")
def topic_words(spark: SparkSession, d: str) -> DataFrame:
    """ML35 over words and pairs of ideographs, for each class of author posts."""
    df = posts(spark, d).where("text IS NOT NULL").select("post_type", tx.tokens(tx.strict(F.col("text"))).alias("toks"))
    return tp.top_words(tp.class_tf_idf(df, "post_type", F.col("toks")), "post_type").withColumn("weight", r(F.col("weight"), 8))


_CENTRES = "e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL)"


@query(f"WITH {_CENTRES}, s AS (SELECT vec_id, c.label, sum(x * m) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(m * m))) AS s FROM e JOIN c USING (i) GROUP BY ALL) SELECT vec_id, CASE WHEN max(s) >= 0.4 THEN CAST(arg_max(s.label, (s, CAST(s.label AS VARCHAR))) AS VARCHAR) ELSE 'Unknown' END AS topic, round(max(s), 5) AS similarity FROM s GROUP BY 1")
def seed_topic_argmax(spark: SparkSession, d: str) -> DataFrame:
    """J16."""
    from tidemark.operators.features import centroids

    e = table(spark, d, "embeddings")
    return tp.nearest_topic(e, "vec_id", "embedding", centroids(e, ["label"], "embedding"), "label", "centroid").withColumn("similarity", r(F.col("similarity"), 5))


_COSINES = f"{_CENTRES}, pair AS (SELECT CAST(x.label AS VARCHAR) AS a, CAST(y.label AS VARCHAR) AS b, sum(x.m * y.m) / (sqrt(sum(x.m * x.m)) * sqrt(sum(y.m * y.m))) AS s FROM c x JOIN c y USING (i) GROUP BY ALL)"


@query(f"WITH RECURSIVE {_COSINES}, near AS MATERIALIZED (SELECT a, b FROM pair WHERE a = b OR s >= 0.65), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a) SELECT a AS topic, min(b) AS root FROM reach GROUP BY a")
def centroid_merge(spark: SparkSession, d: str) -> DataFrame:
    """J15, ML37."""
    from tidemark.operators.features import centroids

    return tp.merge_topics(centroids(table(spark, d, "embeddings"), ["label"], "embedding"), "label", "centroid")


@query()
def embedding_topics(spark: SparkSession, d: str) -> DataFrame:
    """ML36 stand-in: bisecting k-means over embeddings, then merging of near centres (cosine at least 0.65); sizes by topic."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", "embedding", array_to_vector("embedding").alias("features"))
    model = BisectingKMeans(k=10, seed=1).fit(e)
    centres = spark.createDataFrame([(str(i), list(map(float, c))) for i, c in enumerate(model.clusterCenters())], "topic string, centre array<double>")
    roots = tp.merge_topics(centres, "topic", "centre")
    found = model.transform(e).select(F.col("prediction").cast("string").alias("topic"))
    return found.join(roots, "topic").groupBy(F.col("root").cast("int").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


# ---- sentiment rules, entities of the schedule, pages


@query(f"WITH {POSTS} SELECT post_id, CAST(CASE WHEN regexp_matches(text, '转发微博|图片评论') THEN 0.5 WHEN regexp_matches(text, '退钱|避雷|闪退') THEN 0.1 WHEN regexp_matches(text, '好看|支持|绝了') THEN 0.9 ELSE 0.5 END AS DOUBLE) AS score FROM posts WHERE text IS NOT NULL")
def sentiment_cascade(spark: SparkSession, d: str) -> DataFrame:
    """SF32: the lexicon decides; without a model the rest is neutral."""
    p = posts(spark, d).where("text IS NOT NULL")
    return p.select("post_id", tx.sentiment_rules(F.lit(0.5), F.col("text"), ["转发微博", "图片评论"], ["退钱", "避雷", "闪退"], ["好看", "支持", "绝了"]).alias("score"))


@query(f"WITH {POSTS}, {OFFICIAL}, s AS (SELECT post_id, CASE WHEN ts >= TIMESTAMP '2025-02-01' AND ts < TIMESTAMP '2025-06-01' THEN 'v1' WHEN ts >= TIMESTAMP '2025-06-01' AND ts < TIMESTAMP '2026-01-01' THEN 'v2' END AS version, text FROM posts WHERE ts IS NOT NULL AND text IS NOT NULL) SELECT post_id, CASE WHEN contains(text, '霁川') THEN '霁川' WHEN contains(text, '新衣服') THEN version || '/new' END AS entity FROM s")
def generic_entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """SF38: a named entity, else a generic word that the version of the time resolves."""
    sched = spark.createDataFrame([("v1", "2025-02-01", "2025-06-01"), ("v2", "2025-06-01", "2026-01-01")], "version string, s string, e string").select("version", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    p = wn.interval_label(posts(spark, d).where("ts IS NOT NULL AND text IS NOT NULL"), sched, "ts", "s", "e", "version")
    return p.select("post_id", F.when(F.col("text").contains("霁川"), "霁川").when(F.col("text").contains("新衣服"), F.concat(F.col("version"), F.lit("/new"))).alias("entity"))


@query(f"WITH {POSTS} SELECT post_id, author_name, nullif(trim(text, ' '), '') AS text FROM posts")
def html_card_extract(spark: SparkSession, d: str) -> DataFrame:
    """SC10: pages are written from the posts, one for each post, and read back card by card; spaces around a text go."""
    text, author = (escaped(F.coalesce(c, F.lit(""))) for c in ("text", "author_name"))
    html = F.concat(F.lit('<html><div class="card-wrap" mid="'), F.col("post_id"), F.lit('"><p class="txt" nick-name="'), author, F.lit('">'), text, F.lit("</p><li>转发 3</li></div></html>"))
    return cards(posts(spark, d).select(html.alias("html")), "html").select("post_id", "author_name", "text")


QUERIES, ORACLES = Q, O
