"""Calendar expressions of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.schema import HOLIDAYS

# Fixed value: day number of 1970-01-01 when 0001-01-01 is day 1.
_EPOCH_ORDINAL = 719163


def holiday_flag(date: Column) -> Column:
    month_day = F.month(date) * 100 + F.dayofmonth(date)
    return month_day.isin(*HOLIDAYS).cast("int")


def ordinal_day(date: Column) -> Column:
    return F.unix_date(date.cast("date")) + _EPOCH_ORDINAL


def weekday_monday0(date: Column) -> Column:
    return F.weekday(date)
