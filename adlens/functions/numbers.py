"""Number expressions: readings of raw text, guarded ratios, rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.functions.text import na_to_null
from adlens.schema import Z_BY_LEVEL, Z_OTHERWISE

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def as_number(raw: Column) -> Column:
    """The value when the whole text is one number, else null (no missing token is a number).

    The pattern keeps out what a cast would also take: type suffixes (5d) and hexadecimal.
    """
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double"))


def as_bare_digits(raw: Column) -> Column:
    """The value of the digits and dots alone: currency signs, separators and minus are dropped."""
    return F.regexp_replace(na_to_null(raw), r"[^\p{Nd}.]", "").try_cast("double")


def as_signed(raw: Column) -> Column:
    """The value without currency signs and separators, sign kept; (50) means -50."""
    token = F.regexp_replace(na_to_null(raw), r"[\p{Sc}\s,]", "")
    return F.coalesce(
        as_number(raw), as_number(F.regexp_replace(token, r"^\((.*)\)$", "-$1"))
    )


def is_text(raw: Column, number: Column | None = None) -> Column:
    """True when a present value is not a number, which makes its whole column text."""
    number = as_number(raw) if number is None else number
    return number.isNull() & na_to_null(raw).isNotNull()


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first case that holds, else ``otherwise``."""
    values = F.lit(otherwise)
    for condition, value in reversed(list(cases)):
        values = F.when(condition, F.lit(value)).otherwise(values)
    return values


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 where the denominator is not above zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    """Change in percent, 0.0 where there is nothing to compare with."""
    return F.when(old > 0, (new - old) / old * 100.0).otherwise(F.lit(0.0))


def settled(col: Column) -> Column:
    """Without the last digits, in which the order of a sum shows, so that halves round alike."""
    return F.round(col, 6)


def half_up(col: Column) -> Column:
    """Round to a whole number, halves upwards."""
    return F.floor(settled(col) + 0.5)


def half_up_tenth(col: Column) -> Column:
    """Round to one decimal, halves upwards."""
    return F.floor(settled(col) * 10.0 + 0.5) / 10.0


def not_negative(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def z_score(level: float | Column) -> Column:
    """Width of the forecast band in standard deviations; unknown levels count as 99 %."""
    level = level if isinstance(level, Column) else F.lit(float(level))
    return first_match([(level == known, z) for known, z in Z_BY_LEVEL.items()], Z_OTHERWISE)


def mean_of(values: Column) -> Column:
    """Mean of a double array."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def spread_of(values: Column, mean: Column) -> Column:
    """Population standard deviation of a double array whose mean is known."""
    squares = F.aggregate(values, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
    return F.sqrt(squares / F.size(values))
