"""Media links of posts and their places in a store that is spread over folders by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that a link may have; others are refused.
LEGAL = r"^[A-Za-z0-9:/._?&=%-]+$"


def media_paths(df: DataFrame, lists: str, single: str) -> DataFrame:
    """(url, name, path): every distinct legal link of a ', '-joined column and a plain column."""
    urls = df.select(F.explode(F.array_append(F.coalesce(F.split(lists, ", "), F.array().cast("array<string>")), F.col(single))).alias("url"))
    legal = urls.where(F.col("url").isNotNull() & (F.col("url") != "") & F.col("url").rlike(LEGAL)).distinct()
    name = F.md5(F.col("url").cast("binary"))
    return legal.select("url", name.alias("name"), F.concat(F.substring(name, 1, 2), F.lit("/"), name, F.lit(".jpg")).alias("path"))


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content) of the stored files under a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
