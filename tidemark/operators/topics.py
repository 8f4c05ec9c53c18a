"""Words that tell classes apart, seed topics, and merging of similar topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.session import materialize


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, n), most frequent first."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def class_tf_idf(df: DataFrame, cls: str, tokens: Column) -> DataFrame:
    """(cls, word, n, weight): term counts times log(1 + A / (count in all classes + 1)), scaled to sum 1 in each class.

    A is the mean number of words of a class. Two aggregations; the totals are one row, joined as such. The texts are cut
    into words once: the counts are written to the shared folder.
    """
    tf = df.select(cls, F.explode(tokens).alias("word")).groupBy(cls, "word").agg(F.count(F.lit(1)).alias("n"))
    tf = materialize(tf, "terms")
    words = tf.groupBy("word").agg(F.sum("n").alias("all_"))
    mean = tf.agg((F.sum("n") / F.count_distinct(cls)).alias("a_"))
    raw = tf.join(words, "word").join(mean).withColumn("w_", F.col("n") * F.ln(1 + F.col("a_") / (F.col("all_") + 1)))
    total = raw.groupBy(cls).agg(F.sum("w_").alias("t_"))
    return raw.join(total, cls).select(cls, "word", "n", (F.col("w_") / F.col("t_")).alias("weight"))


def top_words(weights: DataFrame, cls: str, k: int = 5, least_share: float = 0.1) -> DataFrame:
    """The k words of most weight of each class, none under a share of the class's best."""
    w = Window.partitionBy(cls).orderBy(F.desc("weight"), "word")
    ranked = weights.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= k)
    best = F.max("weight").over(Window.partitionBy(cls))
    return ranked.withColumn("b_", best).where(F.col("weight") >= least_share * F.col("b_")).select(cls, F.col("k_").alias("rank"), "word", "weight")


def nearest_topic(df: DataFrame, key: str, vector: str, topics: DataFrame, name: str, centre: str, least: float = 0.4) -> DataFrame:
    """(key, topic, similarity): the topic of highest cosine, or 'Unknown' below the least.

    topics is a table of seeds: they are gathered into one array of one row, so each vector is compared where it is.
    """
    seeds = topics.agg(F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("n"), F.col(centre).alias("c")))).alias("seeds_"))
    scored = F.transform("seeds_", lambda s: F.struct(F.coalesce(cosine(F.col(vector), s["c"]), F.lit(-2.0)).alias("s"), s["n"].alias("n")))
    best = F.array_max(F.transform(scored, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"))))
    return df.join(seeds).withColumn("b_", best).select(key, F.when(F.col("b_.s") >= least, F.col("b_.n")).otherwise("Unknown").alias("topic"), F.col("b_.s").alias("similarity"))


def merge_topics(topics: DataFrame, name: str, centre: str, least: float = 0.65) -> DataFrame:
    """(topic, root): topics whose centres are similar, directly or over others, share a root. Topics are few by nature."""
    from tidemark.operators.visual import components

    a = topics.select(F.lit(0).alias("w"), F.col(name).cast("string").alias("a"), F.col(centre).alias("ca"))
    b = topics.select(F.lit(0).alias("w"), F.col(name).cast("string").alias("b"), F.col(centre).alias("cb"))
    links = a.join(b, "w").where((F.col("a") < F.col("b")) & (cosine(F.col("ca"), F.col("cb")) >= least)).select("w", "a", "b")
    return components(links, "w", a.select("w", "a"), "a").select(F.col("node").alias("topic"), "root")
