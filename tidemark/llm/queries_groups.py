"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup
from tidemark.operators.visual import components_global
from tidemark.session import materialize
from tidemark.sources.tables import table

THRESHOLD = 0.6
LEAST_POINTS = 20
#: Posts of one text that are paired in one block; hot texts have as many blocks as they need, on both sides of a pair.
BLOCK = 2_000


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "merged_post").select("post_id", F.col("text").alias("txt")).where(F.col("post_id").isNotNull() & (F.char_length("txt") >= LEAST_POINTS)).withColumn("h", neardup.name_of("txt"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(post_id, h) of the posts that are long enough, and (a, b, similarity) of different texts, named by digests h."""
    posts = _posts(spark, sf_dir)
    texts = materialize(posts.groupBy("h").agg(F.first("txt").alias("txt")), "texts")
    return materialize(posts.select("post_id", "h").distinct(), "posts"), materialize(neardup.near_pairs(texts, "h", "txt", THRESHOLD), "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts whose texts share at least 0.6 of their 3-code-point substrings; identical texts count.

    A text's posts are cut into blocks by their number, and each pair of blocks of two linked texts is joined by itself, so
    neither side of a hot text stays in one task; texts of a few posts, nearly all, have one block and are not copied.
    """
    posts, links = _links(spark, sf_dir)
    sizes = posts.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    pairs = links.select("a", "b").unionByName(sizes.where("n > 1").select(F.col("h").alias("a"), F.col("h").alias("b")))
    hot = materialize(sizes.select("h", F.ceil(F.col("n") / BLOCK).alias("k")).where("k > 1"), "hot")  # one text in BLOCK posts at most
    k = F.coalesce("k", F.lit(1).cast("bigint"))
    blocked = posts.join(hot, "h", "left").select("post_id", "h", F.pmod(F.xxhash64("post_id"), k).alias("s"))
    for side in ("a", "b"):
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias(f"s_{side}")
        pairs = pairs.join(hot.withColumnRenamed("h", side), side, "left").select(*pairs.columns, block)
    left, right = (blocked.select(F.col("post_id").alias(p), F.col("h").alias(side), F.col("s").alias(f"s_{side}")) for p, side in (("p", "a"), ("q", "b")))
    out = pairs.join(left, ["a", "s_a"]).join(right, ["b", "s_b"]).where((F.col("a") != F.col("b")) & (F.col("p") != F.col("q")) | (F.col("a") == F.col("b")) & (F.col("p") < F.col("q")))
    return out.select(F.least("p", "q").alias("post_id_a"), F.greatest("p", "q").alias("post_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each post that is long enough: its group of near-duplicates, named by the smallest post id in it.

    Groups are the connected components of the links between different texts, with all copies of each; n_links is the
    number of different texts that the post's text is linked with, n_copies the number of posts of the very same text.
    """
    posts, links = _links(spark, sf_dir)
    edges = links.select(F.hex("a").alias("a"), F.hex("b").alias("b"))
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components_global(edges, ends.distinct()).join(degree, "node").select(F.unhex("node").alias("h"), "root", "n_links")
    sizes = posts.groupBy("h").agg(F.count(F.lit(1)).alias("n_copies"), F.min("post_id").alias("first"))
    named = sizes.join(roots, "h", "left").withColumn("root", F.coalesce("root", F.hex("h")))
    least = named.groupBy("root").agg(F.min("first").alias("group_id"))
    texts = named.join(least, "root").select("h", "group_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "n_copies")
    return posts.join(texts, "h").select("post_id", "group_id", "n_links", "n_copies")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
# all pairs of texts that share a substring, exactly; for tables of the size of the SQL check
_PAIRS_SQL = f"""
WITH p AS (SELECT DISTINCT post_id, text, md5(text) AS h FROM merged_post WHERE post_id IS NOT NULL AND length(text) >= {LEAST_POINTS}),
t AS (SELECT DISTINCT h, text FROM p),
s AS (SELECT DISTINCT h, substr(text, i, 3) AS g FROM (SELECT h, text, unnest(generate_series(1, length(text) - 2)) AS i FROM t)),
n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
c AS (SELECT x.h AS a, y.h AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.h < y.h GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE m >= {THRESHOLD} * (x.n + y.n - m) - 1e-9 UNION ALL SELECT h, h FROM t)
SELECT least(x.post_id, y.post_id) AS post_id_a, greatest(x.post_id, y.post_id) AS post_id_b FROM l JOIN p x ON x.h = a JOIN p y ON y.h = b WHERE (a <> b AND x.post_id <> y.post_id) OR (a = b AND x.post_id < y.post_id)
"""
ORACLES: dict[str, str] = {"p3_found": _PAIRS_SQL}
