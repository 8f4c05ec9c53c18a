"""Calendar features of a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the simplified holiday calendar as (month, first day, last day).
HOLIDAYS = ((1, 1, 1), (1, 21, 27), (2, 1, 6), (4, 4, 6), (5, 1, 5), (6, 10, 12), (9, 15, 17), (10, 1, 7))
# First hour after each slot of the day.
SLOT_ENDS = (6, 9, 12, 18, 20, 23)


def is_holiday(ts: Column) -> Column:
    """Whether a time falls on a day of the simplified calendar; null stays null."""
    month, day = F.month(ts), F.day(ts)
    hit = F.lit(False)
    for m, a, b in HOLIDAYS:
        hit = hit | ((month == m) & day.between(a, b))
    return F.when(ts.isNotNull(), hit)


def day_slot(ts: Column) -> Column:
    """Slot of the day from 0 (night) to 6 (late evening)."""
    h = F.hour(ts)
    out = F.when(h < SLOT_ENDS[0], 0)
    for k, end in enumerate(SLOT_ENDS[1:], 1):
        out = out.when(h < end, k)
    return F.when(ts.isNotNull(), out.otherwise(len(SLOT_ENDS)))
