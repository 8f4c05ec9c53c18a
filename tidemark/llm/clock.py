"""Wall times without zone as numbers, whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970-01-01 00:00 on its own clock."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    seconds = (F.extract(F.lit("SECOND"), ts).cast("double") * 1_000_000).cast("bigint")
    return day * 86_400_000_000 + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + seconds


def seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def instant(ts: Column) -> Column:
    """A TIMESTAMP whose value in UTC shows the wall time; for watermarks, which need that type."""
    return F.timestamp_micros(micros(ts))
