"""Queries of projections, filters, set operations and windowed features, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import features as ft
from tidemark.operators import text as tx
from tidemark.operators import windows as wn
from tidemark.operators.calendar import day_slot, is_holiday
from tidemark.plans.common import COMMENTS, OFFICIAL, OFFICIAL_COMMENTS, POSTS, SLOT, UNIFIED, WINDOWS, comments, official, posts, r, unified, windows
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


T0, T1 = "2025-03-01 00:00:00", "2025-06-01 00:00:00"


@query("SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'")
def slice_closed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def slice_halfopen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id", "ts")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"SELECT DISTINCT post_id, {tx.PARSE_SQL.format('created_at')} AS ts FROM merged_post")
def parse_post_date(spark: SparkSession, d: str) -> DataFrame:
    """PF3: the three forms of the collectors alone; every other query reads all forms, see `posts`."""
    return table(spark, d, "merged_post").select("post_id", tx.parse_date(F.col("created_at")).alias("ts")).distinct()


@query(f"WITH {POSTS}, {COMMENTS} SELECT 'post' AS channel, count(*) AS n, count(ts) AS n_timed, min(ts) AS first_ts, max(ts) AS last_ts FROM posts UNION ALL SELECT 'comment', count(*), count(ts), min(ts), max(ts) FROM comments")
def timed_share(spark: SparkSession, d: str) -> DataFrame:
    """How many posts and comments have a time, and their range."""
    n = [F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_timed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    return unified(spark, d).groupBy("channel").agg(*n)


@query(
    r"""SELECT DISTINCT post_id, CASE
  WHEN regexp_matches(created_at, '^\d+分钟前$') THEN r - to_minutes(CAST(regexp_extract(created_at, '(\d+)', 1) AS INT))
  WHEN regexp_matches(created_at, '^\d+小时前$') THEN r - to_hours(CAST(regexp_extract(created_at, '(\d+)', 1) AS INT))
  WHEN regexp_matches(created_at, '^今天 ?\d{1,2}:\d{2}$') THEN try_cast(strftime(r, '%Y-%m-%d') || ' ' || lpad(regexp_extract(created_at, '(\d{1,2}:\d{2})', 1), 5, '0') || ':00' AS TIMESTAMP)
  WHEN regexp_matches(created_at, '^\d{1,2}月\d{1,2}日 ?\d{1,2}:\d{2}$') THEN try_cast(strftime(r, '%Y') || '-' || lpad(regexp_extract(created_at, '^(\d{1,2})月', 1), 2, '0') || '-' || lpad(regexp_extract(created_at, '月(\d{1,2})日', 1), 2, '0') || ' ' || lpad(regexp_extract(created_at, '(\d{1,2}:\d{2})', 1), 5, '0') || ':00' AS TIMESTAMP)
  END AS ts FROM (SELECT *, CAST(epoch_ms(CAST(floor(epoch(crawled_at)) AS BIGINT) * 1000 + 28800000) AS TIMESTAMP) AS r FROM merged_post)"""
)
def parse_relative_time(spark: SparkSession, d: str) -> DataFrame:
    ref = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(crawled_at) + 28800)")
    return table(spark, d, "merged_post").select("post_id", tx.relative_time(F.col("created_at"), ref).alias("ts")).distinct()


@query("SELECT DISTINCT post_id, reposts_count, try_cast(trim(reposts_count) AS BIGINT) AS reposts FROM merged_post WHERE reposts_count IS NULL OR NOT regexp_matches(reposts_count, '[.eE_]')")
def counts_as_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "merged_post")
    return df.select("post_id", "reposts_count", tx.count_number(F.col("reposts_count")).alias("reposts")).distinct()


@query(f"WITH {UNIFIED} SELECT channel, count(*) AS n, count(post_type) AS n_typed, count(fan_level) AS n_fans FROM unified GROUP BY channel")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    return unified(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("post_type").alias("n_typed"), F.count("fan_level").alias("n_fans"))


@query(f"WITH {UNIFIED} SELECT {SLOT} AS w FROM unified WHERE channel = 'post' AND ts IS NOT NULL INTERSECT SELECT {SLOT} FROM unified WHERE channel = 'comment' AND ts IS NOT NULL")
def intersect_windows(spark: SparkSession, d: str) -> DataFrame:
    u = unified(spark, d).where("ts IS NOT NULL").select("channel", wn.slot(F.col("ts")).alias("w"))
    return u.where("channel = 'post'").select("w").intersect(u.where("channel = 'comment'").select("w"))


@query(f"WITH {UNIFIED} SELECT {SLOT} AS w FROM unified WHERE channel = 'post' AND ts IS NOT NULL EXCEPT SELECT {SLOT} FROM unified WHERE channel = 'comment' AND ts IS NOT NULL")
def except_windows(spark: SparkSession, d: str) -> DataFrame:
    u = unified(spark, d).where("ts IS NOT NULL").select("channel", wn.slot(F.col("ts")).alias("w"))
    return u.where("channel = 'post'").select("w").distinct().join(u.where("channel = 'comment'").select("w"), "w", "left_anti")


@query("SELECT official_uid, time_idx, pred_label, state FROM (SELECT *, row_number() OVER (PARTITION BY official_uid, time_idx ORDER BY baseline_version DESC, \"timestamp\" DESC, pred_label DESC NULLS LAST) AS k FROM adaptive_detection_resultv5) WHERE k = 1")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "adaptive_detection_resultv5").select("official_uid", "time_idx", "timestamp", "baseline_version", "pred_label", "state")
    return wn.dedup(df, ["official_uid", "time_idx"], [F.desc("baseline_version"), F.desc("timestamp"), F.desc_nulls_last("pred_label")]).select("official_uid", "time_idx", "pred_label", "state")


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


# Classes of official post types.
CATEGORY = {"PV": "promotion_main", "版本预告": "promotion_main", "抽奖": "promotion_normal", "其他活动": "promotion_other", "官方攻略": "guide", "搭配指南": "guide", "维护公告": "maintenance", "更新公告": "maintenance", "致歉": "crisis", "维护&道歉": "crisis", "日常互动": "daily"}
_CAT_SQL = "CASE official_post_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " ELSE 'daily' END"


@query(f"WITH {OFFICIAL} SELECT post_id, {_CAT_SQL} AS class, CAST(CASE WHEN official_uid = '7100000000' THEN 1.0 WHEN official_uid IS NULL THEN 1.0 ELSE 0.3 END AS DOUBLE) AS weight FROM official")
def channel_map_default(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv))
    weight = F.create_map(F.lit("7100000000"), F.lit(1.0))
    return official(spark, d).select("post_id", F.coalesce(F.element_at(codes, F.col("official_post_type")), F.lit("daily")).alias("class"), F.when(F.col("official_uid").isNull(), 1.0).otherwise(F.coalesce(F.element_at(weight, F.col("official_uid")), F.lit(0.3))).alias("weight"))


NEUTRAL = ["兑换码", "QQ群", "游戏UID", "订单NO."]
#: Sources whose retweets are cut or dropped, and authors whose posts are no opinion; lists that a user curates.
OFFICIAL_SOURCES, IRRELEVANT_SOURCES, OFFICIAL_AUTHORS = ["潮轮_0", "曜花_2", "鲸歌云旅"], ["星光_13", "霞水_6"], ["潮轮_0", "星月_1", "鲸歌云旅"]


def _names(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_STRICT = "trim(regexp_replace(regexp_replace({0}, '//@[^:：]*[:：]?|回复@[^:：]*[:：]?|@[0-9A-Za-z_-]+|#[^#]*#|https?://[^\\s]+|\\[[^\\]]*\\]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')"
_CLEAN = (
    f"{POSTS}, cut AS (SELECT *, CASE WHEN post_type = 'retweet' AND source_author_name IN {_names(OFFICIAL_SOURCES)} THEN split_part(text, '//@', 1) ELSE text END AS t FROM posts), "
    f"kept AS (SELECT *, CASE WHEN text IS NOT NULL THEN CASE WHEN coalesce(post_type = 'retweet' AND source_author_name IN {_names(IRRELEVANT_SOURCES)}, false) OR t = '' OR regexp_matches(t, '兑换码|QQ群|游戏UID|订单NO\\.') THEN 'FILTER_NEUTRAL_LEACHING' ELSE t END END AS k FROM cut), "
    f"cleaned AS (SELECT *, {_STRICT.format('k')} AS text_clean_strict, CASE WHEN length({_STRICT.format('k')}) < 2 THEN 'FILTER_NEUTRAL_LEACHING' ELSE k END AS text_clean FROM kept)"
)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return tx.clean_texts(posts(spark, d), "text", "source_author_name", F.col("post_type") == "retweet", OFFICIAL_SOURCES, IRRELEVANT_SOURCES, NEUTRAL)


@query(f"WITH {_CLEAN} SELECT post_id, text_clean, text_clean_strict, coalesce(text_clean = 'FILTER_NEUTRAL_LEACHING', false) AS is_filtered FROM cleaned")
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """PF10: the whole of cleaning, on every post."""
    return _cleaned(spark, d).select("post_id", "text_clean", "text_clean_strict", "is_filtered")


@query(f"WITH {_CLEAN} SELECT post_id, source_author_name, text_clean FROM cleaned WHERE post_type = 'retweet'")
def official_mask_split(spark: SparkSession, d: str) -> DataFrame:
    """PF7: retweets, cut where the source is official, marked where it is irrelevant."""
    return _cleaned(spark, d).where("post_type = 'retweet'").select("post_id", "source_author_name", "text_clean")


@query(f"WITH {POSTS} SELECT post_id, CASE WHEN t IS NULL THEN NULL WHEN t = '' OR regexp_matches(t, '兑换码|QQ群|游戏UID|订单NO\\.') OR length({_STRICT.format('t')}) < 2 THEN 'FILTER_NEUTRAL_LEACHING' ELSE t END AS text_clean FROM (SELECT post_id, text AS t FROM posts)")
def keyword_sentinel(spark: SparkSession, d: str) -> DataFrame:
    """PF8: neutral words alone; sources are left as they are."""
    return tx.clean_texts(posts(spark, d), "text", "source_author_name", F.lit(False), [], [], NEUTRAL).select("post_id", "text_clean")


@query(f"WITH {POSTS} SELECT post_id, author_name FROM posts WHERE coalesce(trim(image_urls, ' '), '') = '' AND coalesce(trim(video_cover_url, ' '), '') = '' AND coalesce(author_name NOT IN {_names(OFFICIAL_AUTHORS)}, true)")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF11: posts without images and videos, not by official authors."""
    return tx.without_noise(posts(spark, d), "image_urls", ["video_cover_url"], "author_name", OFFICIAL_AUTHORS).select("post_id", "author_name")


@query(f"WITH {_CLEAN} SELECT post_id, text_clean_strict FROM cleaned WHERE text_clean IS NOT NULL AND text_clean <> 'FILTER_NEUTRAL_LEACHING' AND length(text_clean_strict) > 1 AND trim(text_clean_strict, ' ') <> '' AND post_id NOT IN (SELECT original_post_id FROM df_sentences WHERE original_post_id IS NOT NULL)")
def topic_input(spark: SparkSession, d: str) -> DataFrame:
    """PF12, PF13: posts fit for topic models whose sentences aren't there yet."""
    processed = table(spark, d, "df_sentences").where("original_post_id IS NOT NULL").select(F.col("original_post_id").alias("post_id"))
    return tx.topic_input(_cleaned(spark, d), "text_clean", "text_clean_strict", processed, "post_id").select("post_id", "text_clean_strict")


@query(f"WITH {POSTS} SELECT post_id, trim(regexp_replace(regexp_replace(text, '//@[^:：]*[:：]?|回复@[^:：]*[:：]?|@[0-9A-Za-z_-]+|#[^#]*#|https?://[^\\s]+|\\[[^\\]]*\\]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM posts WHERE text IS NOT NULL")
def strict_strip(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("text IS NOT NULL").select("post_id", tx.strict(F.col("text")).alias("t"))


@query(f"WITH {OFFICIAL_COMMENTS} SELECT comment_id, date_diff('day', official_ts, ts) AS days, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN '当日' WHEN d BETWEEN 1 AND 3 THEN '1-3天' WHEN d BETWEEN 4 AND 7 THEN '4-7天' WHEN d BETWEEN 8 AND 15 THEN '8-15天' WHEN d BETWEEN 16 AND 30 THEN '16-30天' ELSE '30天以上' END AS label FROM (SELECT *, date_diff('day', official_ts, ts) AS d FROM comments)")
def relative_day_bucket(spark: SparkSession, d: str) -> DataFrame:
    days = F.date_diff(F.col("ts").cast("date"), F.col("official_ts").cast("date"))
    return comments(spark, d, official=True).select("comment_id", days.cast("bigint").alias("days"), tx.day_label(days).alias("label"))


def _feature_sql(c: str) -> str:
    n = f"regexp_extract_all(CASE WHEN channel = '{c}' THEN text END, '[❗!！\\?？🕯️]')"
    on = f"channel = '{c}'"
    return (
        f"count(CASE WHEN {on} THEN text END) AS total_volume_{c}, count(DISTINCT CASE WHEN {on} THEN author_id END) AS unique_users_{c}, "
        f"CAST(coalesce(sum(CASE WHEN {on} THEN least(len({n}), 5) END), 0) AS BIGINT) AS senti_symbol_{c}, "
        f"count(*) FILTER ({on} AND length(text) < 10) AS total_short_{c}, count(*) FILTER ({on} AND length(text) BETWEEN 10 AND 50) AS total_medium_{c}, count(*) FILTER ({on} AND length(text) > 50) AS total_long_{c}"
    )


_FEATURES = f"SELECT {SLOT} AS w, {_feature_sql('post')}, {_feature_sql('comment')}, round(count(*) FILTER (channel = 'post' AND post_type = 'retweet') / (count(CASE WHEN channel = 'post' THEN text END) + 15.0), 6) AS retweet_ratio_post FROM unified WHERE ts IS NOT NULL GROUP BY 1"


@query(f"WITH {UNIFIED} {_FEATURES}")
def channel_features_15min(spark: SparkSession, d: str) -> DataFrame:
    """AG1, AG2, AG4, AG5, AG7 of both channels in one aggregation."""
    u = unified(spark, d).where("ts IS NOT NULL").withColumn("w", wn.slot(F.col("ts")))
    out = ft.channel_features(u, ["w"], F.col("channel"), "text", "author_id", F.col("post_type") == "retweet")
    return out.withColumn("retweet_ratio_post", r(F.col("retweet_ratio_post")))


@query(f"WITH {UNIFIED}, f AS ({_FEATURES}), s AS (SELECT unnest(generate_series((SELECT min(w) FROM f), (SELECT max(w) FROM f), INTERVAL 15 MINUTE)) AS w) SELECT s.w, coalesce(f.total_volume_post, 0) AS total_volume_post, coalesce(f.total_volume_comment, 0) AS total_volume_comment FROM s LEFT JOIN f ON s.w = f.w")
def spine_fill(spark: SparkSession, d: str) -> DataFrame:
    f = channel_features_15min(spark, d).select("w", "total_volume_post", "total_volume_comment")
    grid = wn.spine(f.withColumn("all_", F.lit(0)), ["all_"], "w").select("w")
    return grid.join(f, "w", "left").fillna(0)


def _gini_sql(bucket: str) -> str:
    return f"""WITH {UNIFIED}, c AS (SELECT channel, {bucket} AS w, author_id, count(*) AS n FROM unified WHERE ts IS NOT NULL AND author_id IS NOT NULL GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY channel, w ORDER BY n, author_id) AS i FROM c),
  g AS (SELECT channel, w, count(*) AS users, sum(n) AS total, 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS v FROM k GROUP BY ALL)
  SELECT channel, w, users, CAST(total AS BIGINT) AS total, round(CASE WHEN users < 5 AND total < 10 THEN 0.0 WHEN users = 1 THEN 1.0 ELSE least(greatest(v, 0.0), 1.0) END, 6) AS gini FROM g"""


def _gini(spark: SparkSession, d: str, bucket) -> DataFrame:
    c = unified(spark, d).where("ts IS NOT NULL AND author_id IS NOT NULL").groupBy("channel", bucket.alias("w"), "author_id").agg(F.count(F.lit(1)).alias("n"))
    return ft.gini(c, ["channel", "w"], "n").select("channel", "w", "users", F.col("rows").alias("total"), r(F.col("gini")).alias("gini"))


@query(_gini_sql(SLOT))
def gini_15min(spark: SparkSession, d: str) -> DataFrame:
    return _gini(spark, d, wn.slot(F.col("ts")))


@query(_gini_sql("date_trunc('day', ts)"))
def gini_daily(spark: SparkSession, d: str) -> DataFrame:
    return _gini(spark, d, F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL '15 minutes', \"timestamp\") AS w, count(*) AS n, round((count(*) FILTER (sentiment_score < 0.4) + 2.25) / (count(*) + 15), 6) AS neg_ratio, round(avg(CASE WHEN sentiment_score < 0.4 THEN 1.0 ELSE 0.0 END), 6) AS raw_ratio, round(avg(sentiment_score), 6) AS mean_score FROM (SELECT DISTINCT * FROM df_sentences) WHERE \"timestamp\" IS NOT NULL GROUP BY 1")
def neg_ratio_bayes(spark: SparkSession, d: str) -> DataFrame:
    """AG8, AG9, AG10."""
    df = table(spark, d, "df_sentences").distinct().where("timestamp IS NOT NULL")
    s = F.col("sentiment_score")
    return df.groupBy(wn.slot(F.col("timestamp")).alias("w")).agg(F.count(F.lit(1)).alias("n"), r(ft.negative_ratio(s)).alias("neg_ratio"), r(F.avg(F.when(s < 0.4, 1.0).otherwise(0.0))).alias("raw_ratio"), r(F.avg(s)).alias("mean_score"))


@query()
def compression_ratio_daily(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).where("ts IS NOT NULL").withColumn("day", F.col("ts").cast("date"))
    return tx.compression_ratio(df, ["day"], "text", ["ts", "post_id"])


@query(f"WITH {POSTS}, {COMMENTS} SELECT (SELECT round(count(*) FILTER (source_post_id IS NULL) / (count(*) + 1e-5), 6) FROM posts) AS original_ratio, (SELECT round(count(*) FILTER (fan_level <> '') / nullif(count(*), 0), 6) FROM comments) AS core_fans, (SELECT round(count(*) FILTER (user_title = '超话小主持人') / nullif(count(*), 0), 6) FROM comments) AS hosts")
def original_and_core_ratios(spark: SparkSession, d: str) -> DataFrame:
    """AG14, AG16."""
    p = posts(spark, d).agg(r(F.count_if(F.col("source_post_id").isNull()) / (F.count(F.lit(1)) + 1e-5)).alias("original_ratio"))
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    c = comments(spark, d).agg(r(F.count_if(F.col("fan_level") != "") / n).alias("core_fans"), r(F.count_if(F.col("user_title") == "超话小主持人") / n).alias("hosts"))
    return p.join(c)  # one row each


@query(f"WITH {OFFICIAL}, {POSTS}, o AS (SELECT {SLOT} AS w, count(*) AS n_official FROM official WHERE ts IS NOT NULL GROUP BY 1), p AS (SELECT {SLOT} AS w, count(*) AS n_post FROM posts WHERE ts IS NOT NULL GROUP BY 1) SELECT coalesce(o.w, p.w) AS w, n_official, n_post, n_official + n_post AS total, round(n_official / (n_official + n_post), 6) AS coupling FROM o FULL JOIN p ON o.w = p.w")
def coupling_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AG15: a side that is missing leaves the total and the ratio null."""
    o = official(spark, d).where("ts IS NOT NULL").groupBy(wn.slot(F.col("ts")).alias("w")).agg(F.count(F.lit(1)).alias("n_official"))
    p = posts(spark, d).where("ts IS NOT NULL").groupBy(wn.slot(F.col("ts")).alias("w")).agg(F.count(F.lit(1)).alias("n_post"))
    total = F.col("n_official") + F.col("n_post")
    return o.join(p, "w", "full").select("w", "n_official", "n_post", total.alias("total"), r(F.col("n_official") / total).alias("coupling"))


@query(f"WITH {POSTS} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(text) AS n, CASE WHEN count(text) >= 3 THEN round(stddev_samp(length(text)), 6) END AS length_std FROM posts WHERE ts IS NOT NULL GROUP BY 1")
def length_std_gated(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("text")
    return posts(spark, d).where("ts IS NOT NULL").groupBy(F.col("ts").cast("date").alias("day")).agg(n.alias("n"), F.when(n >= 3, r(F.stddev_samp(F.char_length("text")))).alias("length_std"))


_CENTROID = "SELECT vec_id // 10 AS w, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY ALL"


@query(f"WITH c AS ({_CENTROID}) SELECT w, round(sqrt(sum(m * m)), 6) AS length, round(max(m), 6) AS top FROM c GROUP BY w")
def centroid_by_window(spark: SparkSession, d: str) -> DataFrame:
    c = ft.centroids(table(spark, d, "embeddings").withColumn("w", F.expr("vec_id div 10")), ["w"], "embedding")
    return c.select("w", r(vectors.norm(F.col("centroid"))).alias("length"), r(F.array_max("centroid")).alias("top"))


@query(f"WITH c AS ({_CENTROID}), v AS (SELECT w, list(m ORDER BY i) AS v FROM c GROUP BY w), p AS (SELECT w, v, lag(v) OVER (ORDER BY w) AS u FROM v) SELECT w, round(CASE WHEN u IS NULL THEN 0.0 ELSE 1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) END, 6) AS shift FROM p")
def semantic_shift(spark: SparkSession, d: str) -> DataFrame:
    """WN9, SF13: cosine distance to the last window that isn't empty."""
    c = ft.centroids(table(spark, d, "embeddings").withColumn("w", F.expr("vec_id div 10")), ["w"], "embedding").withColumn("series", F.lit(0))
    w = Window.partitionBy("series").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last("centroid", ignorenulls=True).over(w)
    return c.withColumn("p", prev).select("w", r(F.when(F.col("p").isNull(), 0.0).otherwise(1 - vectors.cosine(F.col("p"), F.col("centroid")))).alias("shift"))


@query(f"WITH {OFFICIAL}, {WINDOWS}, o AS (SELECT official_uid, ts, max(category) AS category FROM official WHERE ts IS NOT NULL AND official_uid IS NOT NULL GROUP BY ALL), g AS (SELECT w.window_id, w.official_uid, w.\"timestamp\" AS t, o.ts AS o_ts, o.category FROM w19 w ASOF LEFT JOIN o ON w.official_uid = o.official_uid AND w.\"timestamp\" >= o.ts), e AS (SELECT *, coalesce((epoch(t) - epoch(o_ts)) / 60.0, 999999.0) AS m, CASE WHEN official_uid = '7100000000' THEN 1.0 ELSE 0.3 END AS k FROM g) SELECT window_id, category, round(exp(-m / 120.0) * k, 6) AS comment_decay, round(exp(-greatest(m - 30, 0.0) / 240.0) * k * 0.6, 6) AS post_decay, CAST(coalesce(exp(-m / 120.0) * k > 0.01 AND category LIKE 'promotion%', false) AS INT) AS promotion_active, CAST(coalesce(exp(-m / 120.0) * k > 0.01 AND category = 'crisis', false) AS INT) AS crisis_active FROM e")
def asof_decay_flags(spark: SparkSession, d: str) -> DataFrame:
    """J1, SF12: the latest official post before each window, its decayed impact and what is active."""
    o = official(spark, d).where("ts IS NOT NULL AND official_uid IS NOT NULL").groupBy("official_uid", "ts").agg(F.max("category").alias("category"))
    w = windows(spark, d).select("window_id", "official_uid", F.col("timestamp").alias("ts"))
    g = wn.as_of(w, o, ["official_uid"], "ts", ["category"])
    m = F.coalesce((F.unix_timestamp("ts") - F.unix_timestamp("right_ts")) / 60.0, F.lit(999999.0))
    g = g.withColumn("m", m).withColumn("k", F.when(F.col("official_uid") == "7100000000", 1.0).otherwise(0.3)).withColumn("cd", F.exp(-F.col("m") / 120.0) * F.col("k"))
    active = F.col("cd") > 0.01
    return g.select("window_id", "category", r(F.col("cd")).alias("comment_decay"), r(F.exp(-F.greatest(F.col("m") - 30, F.lit(0.0)) / 240.0) * F.col("k") * 0.6).alias("post_decay"), F.coalesce(active & F.col("category").startswith("promotion"), F.lit(False)).cast("int").alias("promotion_active"), F.coalesce(active & (F.col("category") == "crisis"), F.lit(False)).cast("int").alias("crisis_active"))


@query(f"WITH {OFFICIAL}, l AS (SELECT CAST(ts AS DATE) AS day, max_by(category, (ts, post_id)) AS event FROM official WHERE ts IS NOT NULL AND category IS NOT NULL GROUP BY 1), k AS (SELECT event, row_number() OVER (ORDER BY event) AS code FROM (SELECT DISTINCT event FROM l)), {WINDOWS} SELECT w.window_id, coalesce(l.event, 'none') AS event, coalesce(k.code, 0) AS code FROM w19 w LEFT JOIN l ON CAST(w.\"timestamp\" AS DATE) = l.day LEFT JOIN k USING (event)")
def event_code_by_day(spark: SparkSession, d: str) -> DataFrame:
    """J11, SF20: the last event of a day wins; events are numbered by name, none is 0."""
    last = official(spark, d).where("ts IS NOT NULL AND category IS NOT NULL").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max_by("category", F.struct("ts", "post_id")).alias("event"))
    names = last.agg(F.array_sort(F.collect_set("event")).alias("names"))  # a handful of classes
    w = windows(spark, d).select("window_id", F.col("timestamp").cast("date").alias("day"))
    out = w.join(last, "day", "left").join(names)
    return out.select("window_id", F.coalesce("event", F.lit("none")).alias("event"), F.coalesce(F.array_position("names", F.col("event")), F.lit(0)).cast("bigint").alias("code"))


@query(f"WITH {WINDOWS} SELECT window_id, hour(t) AS hour, (dayofweek(t) + 6) % 7 AS dow, month(t) AS month, day(t) AS day, CAST((dayofweek(t) + 6) % 7 >= 5 AS INT) AS weekend, CASE WHEN hour(t) < 6 THEN 0 WHEN hour(t) < 9 THEN 1 WHEN hour(t) < 12 THEN 2 WHEN hour(t) < 18 THEN 3 WHEN hour(t) < 20 THEN 4 WHEN hour(t) < 23 THEN 5 ELSE 6 END AS day_slot, (strftime(t, '%m%d') IN ('0101') OR strftime(t, '%m%d') BETWEEN '0121' AND '0127' OR strftime(t, '%m%d') BETWEEN '0201' AND '0206' OR strftime(t, '%m%d') BETWEEN '0404' AND '0406' OR strftime(t, '%m%d') BETWEEN '0501' AND '0505' OR strftime(t, '%m%d') BETWEEN '0610' AND '0612' OR strftime(t, '%m%d') BETWEEN '0915' AND '0917' OR strftime(t, '%m%d') BETWEEN '1001' AND '1007') AS holiday, hour(t) * 4 + minute(t) // 15 AS slot96, CAST(trunc((epoch(t) - epoch(TIMESTAMP '2025-02-01')) / 900) AS BIGINT) AS time_idx FROM (SELECT *, \"timestamp\" AS t FROM w19)")
def time_features(spark: SparkSession, d: str) -> DataFrame:
    """SF18, SF19, SF21, SF22."""
    t = F.col("timestamp")
    h = F.hour(t)
    base = F.lit("2025-02-01 00:00:00").cast("timestamp_ntz")
    return windows(spark, d).select("window_id", h.alias("hour"), F.weekday(t).alias("dow"), F.month(t).alias("month"), F.day(t).alias("day"), (F.weekday(t) >= 5).cast("int").alias("weekend"), day_slot(t).alias("day_slot"), is_holiday(t).alias("holiday"), (h * 4 + F.floor(F.minute(t) / 15)).cast("bigint").alias("slot96"), wn.time_index(t, base).alias("time_idx"))


@query(f"WITH {POSTS} SELECT DISTINCT u AS url, md5(u) AS name, substr(md5(u), 1, 2) || '/' || md5(u) || '.jpg' AS path FROM (SELECT unnest(string_split(image_urls, ', ')) AS u FROM posts WHERE image_urls IS NOT NULL UNION ALL SELECT video_cover_url FROM posts) WHERE u IS NOT NULL AND u <> '' AND regexp_matches(u, '^[A-Za-z0-9:/._?&=%-]+$')")
def media_urls(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC13, SF29: distinct media links with their place in the store."""
    from tidemark.sources.media import media_paths

    return media_paths(posts(spark, d), "image_urls", "video_cover_url")


@query("SELECT text_len, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN NULL WHEN length(text) < 10 THEN 'Short' WHEN length(text) > 50 THEN 'Long' ELSE 'Medium' END AS text_len FROM documents) GROUP BY 1")
def length_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(tx.length_class(F.col("text")).alias("text_len")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POSTS} SELECT post_id, trim(regexp_replace(text, '(?s)//@.*', '')) AS t FROM posts WHERE text IS NOT NULL")
def repost_truncate(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("text IS NOT NULL").select("post_id", tx.cut_repost(F.col("text")).alias("t"))


@query(f"WITH {POSTS} SELECT post_id, trim(s, ' ') AS sentence FROM (SELECT post_id, unnest(regexp_extract_all(text, '[^。！？!?…\\n]*[。！？!?…\\n]|[^。！？!?…\\n]+$')) AS s FROM posts WHERE text IS NOT NULL) WHERE length(trim(s, ' ')) >= 4")
def sentences_explode(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("text IS NOT NULL").select("post_id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))


# words of Latin letters, runs of kana, pairs of ideographs; {0}: a text, as lists
_TOKENS = "list_concat(regexp_extract_all(lower({0}), '[\\p{{Latin}}\\p{{M}}]{{2,}}|[\\p{{Hiragana}}\\p{{Katakana}}ー]{{2,}}'), flatten(list_transform(regexp_extract_all({0}, '\\p{{Han}}{{2,}}'), lambda h: list_transform(generate_series(1, length(h) - 1), lambda i: substr(h, i, 2)))))"


@query(f"WITH {POSTS}, c AS (SELECT post_id, {_TOKENS.format(_STRICT.format('text'))} AS l FROM posts WHERE text IS NOT NULL) SELECT post_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS tokens FROM c")
def deep_clean_dedup(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("text IS NOT NULL").select("post_id", tx.distinct_tokens(tx.strict(F.col("text"))).alias("tokens"))


ALIASES = {"霁川": ["霁川"], "白鹭姐": ["白鹭姐", "白鹭"], "索菲卡": ["索菲卡"], "九号机工": ["九号机工", "九号"], "老灯塔": ["老灯塔"], "乌桐": ["乌桐"], "塔姆": ["塔姆"]}
_ENT_SQL = " UNION ALL ".join(f"SELECT '{e}' AS entity, CAST(coalesce(sum(len(regexp_extract_all(text, '{'|'.join(a)}'))), 0) AS BIGINT) AS n FROM posts" for e, a in ALIASES.items())


@query(f"WITH {POSTS} SELECT entity, n FROM ({_ENT_SQL}) WHERE n > 0 ORDER BY n DESC, entity LIMIT 5")
def entity_alias_top5(spark: SparkSession, d: str) -> DataFrame:
    return tx.entity_counts(posts(spark, d), "text", ALIASES)


@query(f"WITH {POSTS}, f AS (SELECT text, min(post_id) AS post_id FROM posts WHERE text IS NOT NULL GROUP BY text) SELECT post_id, length(text) AS n FROM f ORDER BY n DESC, post_id LIMIT 3")
def topk_longest_texts(spark: SparkSession, d: str) -> DataFrame:
    f = posts(spark, d).where("text IS NOT NULL").groupBy("text").agg(F.min("post_id").alias("post_id"))
    return f.select("post_id", F.char_length("text").cast("bigint").alias("n")).orderBy(F.desc("n"), "post_id").limit(3)


QUERIES, ORACLES = Q, O
