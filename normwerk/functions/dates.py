"""Business days and deadlines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weekdays_until(day: Column) -> Column:
    """Weekdays from Monday, 5 January 1970, to `day`, both included."""
    n = F.date_diff(day, F.lit(dt.date(1970, 1, 5))) + 1
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(start: Column, end: Column, holidays: Iterable[dt.date] = ()) -> Column:
    """Days from start to end, both included, without weekends and holidays; null if either is missing, 0 if the end is earlier.

    `holidays` is a short list, which goes into the expression: no join, no shuffle.
    """
    off = sorted({d for d in holidays if d.weekday() < 5})  # those on weekends are out already
    inside = F.size(F.filter(F.array(*[F.lit(d) for d in off]), lambda h: h.between(start, end))) if off else F.lit(0)
    days = _weekdays_until(end) - _weekdays_until(F.date_sub(start, 1)) - inside
    return F.when(end < start, F.lit(0)).when(start.isNotNull() & end.isNotNull(), days.cast("int"))


def deadline(answer: Column, status: Column, today: Column) -> Column:
    """struct(days_to_answer, overdue, urgent)."""
    left = F.date_diff(answer, today)
    return F.struct(left.alias("days_to_answer"), ((answer < today) & (status != "done")).alias("overdue"), left.between(0, 1).alias("urgent"))
