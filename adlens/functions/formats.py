"""Display formats for report tables and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.functions.numbers import settled


def plain(col: Column, pattern: str) -> Column:
    """A number by pattern, no thousands separators unless the pattern has them."""
    return F.call_function("format_number", settled(col), F.lit(pattern))


def money(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(settled(col), 2))


def money_plain(col: Column) -> Column:
    return F.concat(F.lit("$"), plain(col, "0.00"))


def count(col: Column, decimals: int = 0) -> Column:
    return F.format_number(settled(col), decimals)


def ratio_x(col: Column) -> Column:
    return F.concat(plain(col, "0.00"), F.lit("x"))


def signed_pct(col: Column) -> Column:
    return F.concat(F.when(col >= 0, "+").otherwise(""), plain(col, "0.0"), F.lit("%"))


def iso_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
