"""Queries of problems 1 and 5."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import canonical, pii
from tidemark.sources.tables import table

#: table, id, text
TEXTS = (("merged_post", "post_id", "text"), ("df_sentences", "sentence_id", "sentences"))


def _looks(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, DataFrame]]:
    """Each table's name with the looks of its records."""
    for name, key, text in TEXTS:
        df = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("rec"), F.col(text).alias("txt")).where(F.col("txt").isNotNull())
        yield name, canonical.looks_of(canonical.canonicalize(df, "txt"), "rec", "txt", "canonical")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table whose texts differ in their code points but look the same."""
    parts = [canonical.lookalike_pairs(rows).select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, rows in _looks(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record with a text: the class of records that look the same, and how many spellings it has."""
    parts = [canonical.look_classes(rows).select(F.lit(name).alias("table_name"), F.col("id").alias("rec_id"), "class_id", "n_spellings") for name, rows in _looks(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


#: table, id
WRITTEN = (("merged_comment", "comment_id"), ("merged_post", "post_id"))


def _annotated(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """The records with a mention, or all (`left`), with what is found in their texts."""
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("rec_id"), "text") for n, k in WRITTEN]
    df = parts[0].unionByName(parts[1])
    return df.join(pii.fit_and_find(df, "text"), "text", how)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds a mention of a kind of personal information, one row for each kind."""
    return _annotated(spark, sf_dir, "inner").select("table_name", "rec_id", F.explode("kinds").alias("kind")).distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders for its mentions; one row for each record."""
    out = _annotated(spark, sf_dir, "left").select("table_name", "rec_id", F.coalesce("redacted", "text").alias("redacted"), F.coalesce(F.size("kinds"), F.lit(0)).alias("n"))
    return out.groupBy("table_name", "rec_id").agg(F.max("redacted").alias("text"), F.max(F.greatest("n", F.lit(0))).alias("n_kinds"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p5_found": p5_found, "p5_classes": p5_classes}
ORACLES: dict[str, str] = {}
