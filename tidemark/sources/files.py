"""Files in and out: CSV folders, word lists, lexicons, JSON parameters, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file, or all of a folder; UTF-8 with or without a byte order mark, quoted line breaks; no inference."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True)


def read_words(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "GBK")) -> DataFrame:
    """(word): distinct words of text files, each read in the first encoding that gives no broken character."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    text = _decoded(encodings)
    return raw.select(F.explode(F.split(text, r"\r?\n")).alias("word")).select(F.trim(F.regexp_replace("word", "﻿", "")).alias("word")).where("word <> ''").distinct()


def _decoded(encodings: tuple[str, ...]):
    """Bytes to text in the first encoding that reads all of them; bytes that none reads are replaced."""

    @F.pandas_udf("string")
    def decode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: bytes) -> str:
            for e in encodings:
                try:
                    return b.decode(e)
                except UnicodeDecodeError:
                    pass
            return b.decode(encodings[0], "replace")

        for s in it:
            yield s.map(one, na_action="ignore")

    return decode("content")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, tag) of lines 'word tag'; the tag may be missing."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("word"), F.get(parts, F.lit(1)).alias("tag"))


def stop_words(spark: SparkSession, path: str, builtin: list[str]) -> DataFrame:
    """(word): those marked is_stopword = 1 in a curated table, and the built-in ones."""
    curated = read_csv(spark, path, "word string, is_stopword int").where("is_stopword = 1").select("word")
    return curated.unionByName(spark.createDataFrame([(w,) for w in builtin], "word string")).distinct()


def write_params(spark: SparkSession, path: str, params: dict) -> None:
    """Parameters as one JSON line, readable by any later run."""
    body = asdict(params) if is_dataclass(params) else params
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """A parquet table, in folders by the given columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted so that line breaks survive."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
