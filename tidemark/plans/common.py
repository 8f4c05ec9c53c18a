"""Tables in the shape that the operators take, and the same as SQL for the twins in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timestamps
from tidemark.plans import time_sql
from tidemark.sources.tables import table


def _wall(utc: str) -> Column:
    """The wall time of an instant in the default zone, whose offset doesn't change after 1991."""
    return F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {utc} + 28800)")


_POST = ["post_id", "text", "author_id", "author_name", "post_type", "source_post_id", "source_author_name", "image_urls", "video_cover_url"]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each post id; ts is the wall time in the default zone of every value that denotes an instant.

    Redelivered rows differ in their counters only, so they are dropped on the columns that are used.
    """
    df = timestamps.normalize(spark, table(spark, sf_dir, "merged_post").select(*_POST, "created_at", "client_tz", "crawled_at"), "created_at", estimate=False)
    return df.select(*_POST, _wall("utc_seconds").alias("ts")).distinct()


_COMMENT = ["comment_id", "post_id", "text", "author_id", "user_title", "fan_level", "official_uid"]


def comments(spark: SparkSession, sf_dir: str, official: bool = False) -> DataFrame:
    """As posts; with `official` also the wall time of the official post that is commented, as official_ts."""
    df = table(spark, sf_dir, "merged_comment").withColumn("author_id", F.col("user_id").cast("string")).select(*_COMMENT, "comment_created_at", "post_date", "client_tz", "crawled_at")
    df = timestamps.normalize(spark, df, "comment_created_at", estimate=False).withColumnRenamed("utc_seconds", "utc").withColumn("ts", _wall("utc"))
    if not official:
        return df.select(*_COMMENT, "ts").distinct()
    df = timestamps.normalize(spark, df.drop("utc"), "post_date", estimate=False)
    return df.select(*_COMMENT, "ts", _wall("utc_seconds").alias("official_ts")).distinct()


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and comments as one stream of (channel, text, author_id, post_type, ts), by name, missing columns null."""
    p = posts(spark, sf_dir).select(F.lit("post").alias("channel"), "text", "author_id", "post_type", "ts")
    c = comments(spark, sf_dir).select(F.lit("comment").alias("channel"), "text", "author_id", "ts", "fan_level")
    return p.unionByName(c, allowMissingColumns=True)


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "temp_all_official_standart_time_type").select("post_id", "content", F.col("timestamp").alias("ts"), "type", "official_uid", "official_author", "official_post_type", "category").distinct()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features_19 without repeated rows and rows without time."""
    return table(spark, sf_dir, "features_19").where(F.col("timestamp").isNotNull()).distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adaptive_detection_resultv5 without repeated rows."""
    return table(spark, sf_dir, "adaptive_detection_resultv5").distinct()


_RAW = "client_tz, crawled_at"
POSTS = f"{time_sql.reading('posts_t', 'merged_post', ', '.join(_POST), 'created_at')}, posts AS (SELECT DISTINCT {', '.join(_POST)}, {time_sql.wall('utc_seconds')} AS ts FROM posts_t)"
_COMMENT_SQL = ", ".join(_COMMENT).replace("author_id", "CAST(user_id AS VARCHAR) AS author_id")
COMMENTS = f"{time_sql.reading('comments_t', 'merged_comment', _COMMENT_SQL, 'comment_created_at')}, comments AS (SELECT DISTINCT {', '.join(_COMMENT)}, {time_sql.wall('utc_seconds')} AS ts FROM comments_t)"
OFFICIAL_COMMENTS = f"{time_sql.reading('comments_t', 'merged_comment', _COMMENT_SQL + ', post_date, ' + _RAW, 'comment_created_at')}, {time_sql.reading('comments_u', 'comments_t', ', '.join(_COMMENT) + ', utc_seconds AS utc', 'post_date')}, comments AS (SELECT DISTINCT {', '.join(_COMMENT)}, {time_sql.wall('utc')} AS ts, {time_sql.wall('utc_seconds')} AS official_ts FROM comments_u)"
UNIFIED = f"{POSTS}, {COMMENTS}, unified AS (SELECT 'post' AS channel, text, author_id, post_type, ts, NULL AS fan_level FROM posts UNION ALL SELECT 'comment', text, author_id, NULL, ts, fan_level FROM comments)"
OFFICIAL = "official AS (SELECT DISTINCT post_id, content, \"timestamp\" AS ts, type, official_uid, official_author, official_post_type, category FROM temp_all_official_standart_time_type)"
WINDOWS = "w19 AS (SELECT DISTINCT * FROM features_19 WHERE \"timestamp\" IS NOT NULL)"
DETECTIONS = "det AS (SELECT DISTINCT * FROM adaptive_detection_resultv5)"
SLOT = "time_bucket(INTERVAL '15 minutes', ts)"


def r(c, n: int = 6):
    """Rounded for comparison: sums of doubles depend on their order."""
    return F.round(c, n) + F.lit(0.0)
