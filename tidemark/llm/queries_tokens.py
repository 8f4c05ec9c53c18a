"""Queries of problems 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing, splitting
from tidemark.sources.tables import table

TOKENIZER = "byte_bpe_50k"


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document; empty and null texts have the empty list."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER)


def _budgets(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[int, int, int]]:
    """(budget_id, capacity, overlap) of a purpose; the table is fixed and has a handful of rows."""
    rows = table(spark, sf_dir, "token_budgets").where(F.col("purpose") == purpose).orderBy("budget_id").collect()
    return [(r["budget_id"], r["capacity"], r["overlap"] or 0) for r in rows]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the containers of every container budget, sizes in tokens."""
    sizes = bpe.count_column(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER).select(F.col("doc_id").cast("string").alias("key"), F.col("n_tokens").alias("size"))
    budgets = [(b, c) for b, c, _ in _budgets(spark, sf_dir, "container")]
    return packing.pack(sizes, budgets).withColumn("key", F.col("key").cast("bigint")).withColumnsRenamed({"key": "doc_id", "size": "n_tokens", "offset": "token_offset"})


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document beyond a piece capacity, for every piece budget."""
    return splitting.split_column(table(spark, sf_dir, "documents"), "doc_id", "text", _budgets(spark, sf_dir, "piece"), TOKENIZER)


QUERIES = {"p7_ids": p7_ids, "p8_containers": p8_containers, "p9_pieces": p9_pieces}
ORACLES: dict[str, str] = {}
