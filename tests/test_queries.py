"""Every core query against its SQL twin, or at least for rows and a stable schema."""

import pytest

from tests.compare import connect, rows_of, sql_rows
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def near(a, b):
    """Equal but for the order in which doubles were added."""
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(near(x, y) for x, y in zip(a, b))
    return abs(a - b) <= 1e-4 * max(1.0, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, name):
    cols, rows = rows_of(QUERIES[name](spark, data))
    want_cols, want = sql_rows(duck, ORACLES[name])
    assert cols == want_cols
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin(spark, data, name):
    """Queries of models and seeded samples: rows, no column without any value, and the same rows again in other partitions."""
    first = rows_of(QUERIES[name](spark, data))
    cols, rows = first
    assert rows and all(any(r[i] is not None for r in rows) for i in range(len(cols)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = rows_of(QUERIES[name](spark, data))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert near(first, again)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.oracles()) <= set(e.queries())
    assert e.entry(spark).count() > 0
