"""KPI ratios, calendar columns, rolling means and lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.calendar import holiday_flag, ordinal_day, weekday_monday0
from adlens.functions.numbers import ratio
from adlens.operators.spread import attach
from adlens.schema import KEYS, LAG_ROWS, MEASURES, ROLLING_ROWS


def with_kpis(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "CTR": ratio(F.col("Clicks"), F.col("Impressions")),
            "CPC": ratio(F.col("Spend"), F.col("Clicks")),
            "CPA": ratio(F.col("Spend"), F.col("Conversions")),
            "ROAS": ratio(F.col("Revenue"), F.col("Spend")),
            "ConvRate": ratio(F.col("Conversions"), F.col("Clicks")),
        }
    )


def with_calendar(df: DataFrame) -> DataFrame:
    date = F.col("Date")
    return df.withColumns(
        {"Month": F.month(date), "Quarter": F.quarter(date), "HolidayFlag": holiday_flag(date)}
    )


def with_model_features(df: DataFrame) -> DataFrame:
    """Inputs of the forecast model besides the holiday flag."""
    date = F.col("Date")
    return df.withColumns(
        {
            "Ordinal": ordinal_day(date),
            "DayOfWeek": weekday_monday0(date),
            "DayOfMonth": F.dayofmonth(date),
            "Month": F.month(date),
        }
    )


def _series(keys: Sequence[str], *more: str):
    return Window.partitionBy(*keys, "Channel", *more).orderBy("Date")


def _rolling_columns(series, n: int) -> dict:
    recent = series.rowsBetween(1 - n, Window.currentRow)
    return {
        "Spend_MA7": F.avg("Spend").over(recent),
        "ROAS_MA7": F.avg("ROAS").over(recent),
    }


def _lag_columns(series, n: int) -> dict:
    return {
        "Spend_Lag7": F.lag("Spend", n, 0.0).over(series),
        "Revenue_Lag7": F.lag("Revenue", n, 0.0).over(series),
    }


def with_rolling(df: DataFrame, keys: Sequence[str] = KEYS, n: int = ROLLING_ROWS) -> DataFrame:
    """Means of spend and of the ROAS ratios over the last ``n`` rows of the series."""
    return df.withColumns(_rolling_columns(_series(keys), n))


def with_lags(df: DataFrame, keys: Sequence[str] = KEYS, n: int = LAG_ROWS) -> DataFrame:
    """Spend and revenue ``n`` rows back, 0.0 where the series is shorter."""
    return df.withColumns(_lag_columns(_series(keys), n))


def engineer_features(
    facts: DataFrame, keys: Sequence[str] = KEYS, grain: str = "day"
) -> DataFrame:
    """All derived columns; the rolling and lag columns share one shuffle and one sort.

    At day grain a series has one row per calendar day, so a window partition stays small.
    At timestamp grain a series has no such bound and is cut into days (``_in_blocks``).
    """
    featured = with_calendar(with_kpis(facts))
    if grain == "timestamp":
        return _in_blocks(featured, keys)
    return with_lags(with_rolling(featured, keys), keys)


def refreshed_features(
    facts: DataFrame, stored: DataFrame, spans: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The derived columns of all rows from a date on, as a run over the whole history gives them.

    ``spans``: (campaign, since), null for the whole campaign, one row each. ``facts``: the rows from
    ``since`` on. ``stored``: earlier results, of which only the last rows of each channel before
    ``since`` are used; no column looks further back.
    """
    series = [*keys, "Channel"]
    needed = [*series, "Date", *MEASURES]
    before = attach(stored.select(*needed), spans, keys, by=["Channel"], how="inner")
    latest = Window.partitionBy(*series).orderBy(F.desc("Date"))
    halo = (
        before.where(F.col("Date") < F.col("since"))
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= max(ROLLING_ROWS - 1, LAG_ROWS))
    )
    joined = facts.select(*needed, F.lit(False).alias("_before")).unionByName(
        halo.select(*needed, F.lit(True).alias("_before"))
    )
    return engineer_features(joined, keys).where(~F.col("_before")).drop("_before")


def _in_blocks(df: DataFrame, keys: Sequence[str], reach: int = LAG_ROWS) -> DataFrame:
    """Rolling and lag columns of long series, computed day by day.

    A day needs the ``reach`` rows before it. Each day's last ``reach`` rows are kept, a second
    pass over those few rows finds the rows that precede each day (they may come from several
    earlier days), and they are put in front of the day before the windows run.
    """
    series = [*keys, "Channel"]
    values = ["Date", "Spend", "Revenue", "ROAS"]
    blocks = df.withColumn("_block", F.to_date("Date"))
    day = Window.partitionBy(*series, "_block")
    tails = (
        blocks.select(*series, "_block", *values)
        .withColumn("_back", F.row_number().over(day.orderBy(F.desc("Date"))))
        .where(F.col("_back") <= reach)
    )
    through = _series(keys).rowsBetween(1 - reach, Window.currentRow)
    day_ends = (
        tails.withColumn("_recent", F.collect_list(F.struct(*values)).over(through))
        .where(F.col("_back") == 1)
        .select(*series, "_block", "_recent")
    )
    days = Window.partitionBy(*series).orderBy("_block")
    halo = (
        day_ends.withColumn("_rows", F.lag("_recent").over(days))
        .select(*series, "_block", F.inline("_rows"))
        .withColumn("_before", F.lit(True))
    )
    joined = blocks.withColumn("_before", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    inside = _series(keys, "_block")
    return (
        joined.withColumns(
            {**_rolling_columns(inside, ROLLING_ROWS), **_lag_columns(inside, LAG_ROWS)}
        )
        .where(~F.col("_before"))
        .drop("_before", "_block")
    )
