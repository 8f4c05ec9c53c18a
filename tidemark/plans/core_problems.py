"""Queries of the general training-data problems (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timestamps
from tidemark.plans import time_sql
from tidemark.sources.tables import table

#: table, its id, its fields with time strings
FIELDS = (("merged_comment", "comment_id", ("comment_created_at", "post_date")), ("merged_post", "post_id", ("created_at",)))

#: A table's field has one kind of writer; the zone it declares completes the group.
WRITER = ("table_name", "field_name")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time string of both tables: one row for each record and field, a table read once."""
    parts = []
    for name, key, fields in FIELDS:
        df = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("rec_id"), "client_tz", "crawled_at", *fields)
        pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))
        parts.append(df.select(F.lit(name).alias("table_name"), "rec_id", "client_tz", "crawled_at", F.inline(pairs)))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values that denote an instant and are not in standard form, with the instant in whole Unix seconds."""
    df = _long(spark, sf_dir).where(F.col("value").isNotNull())
    out = timestamps.normalize(spark, df, "value", writer=WRITER)
    return out.where(F.col("utc_seconds").isNotNull() & ~F.col("is_standard")).select("table_name", "rec_id", "field_name", "utc_seconds").distinct()


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by table and field: values, instants read, values in standard form, extremes."""
    out = timestamps.normalize(spark, _long(spark, sf_dir), "value", writer=WRITER)
    return out.groupBy("table_name", "field_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_values"),
        F.count("utc_seconds").alias("n_instants"),
        F.count_if("is_standard").alias("n_standard"),
        F.min("utc_seconds").alias("first_utc"),
        F.max("utc_seconds").alias("last_utc"),
    )


def p4_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that each field's local values speak for, by declared zone, estimated without looking at that declaration."""
    return timestamps.zone_estimates(_long(spark, sf_dir), "value", "client_tz", "crawled_at", WRITER)


QUERIES = {"p4_found": p4_found, "p4_fields": p4_fields, "p4_zones": p4_zones}

def _long_sql() -> str:
    """Every time string with its reading, by another engine; undeclared zones in the default, as the estimate finds them."""
    parts, names = [], []
    for name, key, fields in FIELDS:
        for f in fields:
            parts.append(time_sql.reading(f"x_{f}", name, f"'{name}' AS table_name, CAST({key} AS VARCHAR) AS rec_id, '{f}' AS field_name, {f} AS value", f))
            names.append(f"SELECT * FROM x_{f}")
    return f"WITH {', '.join(parts)}, x AS ({' UNION ALL '.join(names)})"


def _zones_sql() -> str:
    """Each group's best offset history by the same rule: violations, then the freshest value's delay, then the default."""
    lag = {z: f"(c - {time_sql._at('wall', repr(z))})" for z in timestamps.CANDIDATE_ZONES}
    local = " UNION ALL ".join(f"SELECT table_name, field_name, z0, zone, form, wall, c FROM x_{f}_4" for _, _, fields in FIELDS for f in fields)
    sums = ", ".join(f"count(*) FILTER ({v} < -{timestamps.SKEW}) AS v{i}, coalesce(min({v}) FILTER ({v} >= -{timestamps.SKEW}), {1 << 62}) AS m{i}" for i, v in enumerate(lag.values()))
    each = ", ".join(f"{{'v': v{i}, 'm': m{i}, 'o': {int(z != timestamps.DEFAULT_ZONE)}, 'z': '{z}'}}" for i, z in enumerate(lag))
    return f"{_long_sql()}, l AS (SELECT * FROM ({local}) WHERE wall IS NOT NULL AND zone IS NULL AND c IS NOT NULL AND form NOT IN ('day_word', 'no_year')), s AS (SELECT table_name, field_name, nullif(coalesce(z0, ''), '') AS declared, count(*) AS n_local, {sums} FROM l GROUP BY ALL), b AS (SELECT *, list_sort([{each}])[1] AS best FROM s) SELECT table_name, field_name, declared, n_local, best.v AS violations, CASE WHEN n_local >= {timestamps.LEAST_VALUES} THEN best.z ELSE '{timestamps.DEFAULT_ZONE}' END AS estimated FROM b"


ORACLES: dict[str, str] = {
    "p4_zones": _zones_sql(),
    "p4_found": f"{_long_sql()} SELECT DISTINCT table_name, rec_id, field_name, utc_seconds FROM x WHERE utc_seconds IS NOT NULL AND NOT is_standard",
    "p4_fields": f"{_long_sql()} SELECT table_name, field_name, count(*) AS n_rows, count(value) AS n_values, count(utc_seconds) AS n_instants, count(*) FILTER (is_standard) AS n_standard, min(utc_seconds) AS first_utc, max(utc_seconds) AS last_utc FROM x GROUP BY ALL",
}
