"""Report tables with display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.formats import count, money, ratio_x
from adlens.schema import KEYS


def kpi_callout(summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The four headline values of a report."""
    return summary.select(
        *keys,
        money(F.col("historical_revenue")).alias("historical_revenue"),
        money(F.col("projected_revenue")).alias("projected_revenue"),
        ratio_x(F.col("historical_roas")).alias("historical_roas"),
        ratio_x(F.col("projected_roas")).alias("projected_roas"),
    )


def channel_breakdown(channel_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The seven formatted columns of the channel table."""
    return channel_rows.select(
        *keys,
        "Channel",
        money(F.col("spend")).alias("spend"),
        count(F.col("impressions")).alias("impressions"),
        count(F.col("clicks")).alias("clicks"),
        count(F.col("conversions"), 1).alias("conversions"),
        money(F.col("revenue")).alias("revenue"),
        ratio_x(F.col("roas")).alias("roas"),
    )


def report_tables(
    summary: DataFrame, channel_rows: DataFrame, keys: Sequence[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    return kpi_callout(summary, keys), channel_breakdown(channel_rows, keys)
