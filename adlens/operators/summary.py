"""Summaries of facts and forecasts, rankings, dashboard tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numbers import half_up, pct_change, ratio
from adlens.operators.spread import attach, cut_evenly, running_totals, tie_hash
from adlens.schema import DEFAULT_CHANNEL, HISTORY_DATES, KEYS, MEASURES


def _history() -> Column:
    return ~F.col("IsForecast")


def dataset_summary(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals, overall ROAS and channel count per campaign."""
    per_channel = df.groupBy(*keys, "Channel").agg(
        *[F.sum(c).alias(c) for c in ("Spend", "Revenue", "Conversions")]
    )
    return per_channel.groupBy(*keys).agg(
        F.sum("Spend").alias("total_spend"),
        F.sum("Revenue").alias("total_revenue"),
        F.sum("Conversions").alias("total_conversions"),
        ratio(F.sum("Revenue"), F.sum("Spend")).alias("overall_roas"),
        F.count("*").alias("channels_count"),
    )


def channels(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct channels with the date each first appears."""
    return df.groupBy(*keys, "Channel").agg(F.min("Date").alias("first_date"))


def daily(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(Date, Channel) totals of the five measures."""
    return df.groupBy(*keys, "Date", "Channel").agg(*[F.sum(c).alias(c) for c in MEASURES])


def last_row(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Measures and ROAS of each channel's last date, without a sort.

    Dates are unique within a channel, so the columns may be picked one by one; unlike one struct
    of them, single numbers can be kept in a hash aggregate.
    """
    return df.groupBy(*keys, "Channel").agg(
        F.max("Date").alias("Date"),
        *[F.max_by(c, "Date").alias(c) for c in (*MEASURES, "ROAS")],
    )


def last_n_dates(df: DataFrame, n: int = HISTORY_DATES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each campaign's last ``n`` distinct dates with data, over all channels.

    The n-th last date of a campaign is found among its distinct dates (a short list) and the
    rows are compared with it.
    """
    dates = df.select(*keys, "Date").distinct()
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("Date"))
    since = (
        dates.withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= n)
        .groupBy(*keys)
        .agg(F.min("Date").alias("_since"))
    )
    return (
        attach(df, since, keys, by=["Date", "Channel"], how="inner")
        .where(F.col("Date") >= F.col("_since"))
        .drop("_since")
    )


def _summary_columns(prefix: str, spend: Column, revenue: Column, conversions: Column) -> list:
    return [
        spend.alias(f"{prefix}_spend"),
        revenue.alias(f"{prefix}_revenue"),
        conversions.alias(f"{prefix}_conversions"),
        ratio(revenue, spend).alias(f"{prefix}_roas"),
    ]


def projected_summary(forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals and ROAS of the forecast rows."""
    return (
        forecast.where("IsForecast")
        .groupBy(*keys)
        .agg(*_summary_columns("projected", F.sum("Spend"), F.sum("Revenue"), F.sum("Conversions")))
    )


def forecast_summary(
    forecast: DataFrame, n: int = HISTORY_DATES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """History (last ``n`` distinct dates) next to projection, one row per campaign.

    One pass: rows are summed per date first, so the ranking of dates runs over a short list and
    nothing is joined back.
    """
    measures = ("Spend", "Revenue", "Conversions")
    per_date = forecast.groupBy(*keys, "Date").agg(
        F.max(_history()).alias("_has_history"),
        *[F.sum(F.when(_history(), F.col(c)).otherwise(0.0)).alias(f"_old_{c}") for c in measures],
        *[F.sum(F.when(_history(), 0.0).otherwise(F.col(c))).alias(f"_new_{c}") for c in measures],
    )
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("_has_history"), F.desc("Date"))
    recent = (F.col("_back") <= n) & F.col("_has_history")
    totals = (
        per_date.withColumn("_back", F.row_number().over(newest_first))
        .groupBy(*keys)
        .agg(
            *[F.sum(F.when(recent, F.col(f"_old_{c}")).otherwise(0.0)).alias(f"_old_{c}")
              for c in measures],
            *[F.sum(f"_new_{c}").alias(f"_new_{c}") for c in measures],
        )
    )
    return totals.select(
        *keys,
        *_summary_columns("historical", *[F.col(f"_old_{c}") for c in measures]),
        *_summary_columns("projected", *[F.col(f"_new_{c}") for c in measures]),
    )


def historical_summary(
    forecast: DataFrame, n: int = HISTORY_DATES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Totals and ROAS of the last ``n`` distinct dates with actual data."""
    return forecast_summary(forecast.where(_history()), n, keys).select(
        *keys, *[f"historical_{c}" for c in ("spend", "revenue", "conversions", "roas")]
    )


def channel_summary(forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Channel metrics over all history rows; ratios are ratios of sums."""
    totals = (
        forecast.where(_history())
        .groupBy(*keys, "Channel")
        .agg(*[F.sum(c).alias(f"_{c}") for c in MEASURES])
    )
    spend, revenue = F.col("_Spend"), F.col("_Revenue")
    clicks, conversions = F.col("_Clicks"), F.col("_Conversions")
    return totals.select(
        *keys,
        "Channel",
        spend.alias("spend"),
        revenue.alias("revenue"),
        F.col("_Impressions").alias("impressions"),
        clicks.alias("clicks"),
        conversions.alias("conversions"),
        ratio(revenue, spend).alias("roas"),
        ratio(conversions, clicks).alias("conv_rate"),
        ratio(spend, conversions).alias("cpa"),
        ratio(spend, clicks).alias("cpc"),
    )


def daily_actual_vs_forecast(forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One chart row per date; a date with any actual row shows actuals only."""
    future = F.col("IsForecast")

    def side(column: str, wanted: Column) -> Column:
        return F.sum(F.when(wanted, F.col(column)).otherwise(0.0))

    per_date = forecast.groupBy(*keys, "Date").agg(
        F.bool_and(future).alias("is_forecast"),
        side("Spend", ~future).alias("_spend_old"),
        side("Spend", future).alias("_spend_new"),
        side("Revenue", ~future).alias("_revenue_old"),
        side("Revenue", future).alias("_revenue_new"),
        side("Revenue_Lower", future).alias("_lower"),
        side("Revenue_Upper", future).alias("_upper"),
    )
    ahead = F.col("is_forecast")
    actual = half_up(F.col("_revenue_old"))
    return per_date.select(
        *keys,
        "Date",
        "is_forecast",
        F.when(~ahead, half_up(F.col("_spend_old"))).alias("spend_actual"),
        F.when(ahead, half_up(F.col("_spend_new"))).alias("spend_forecast"),
        F.when(~ahead, actual).alias("revenue_actual"),
        F.when(ahead, half_up(F.col("_revenue_new"))).alias("revenue_forecast"),
        F.when(ahead, half_up(F.col("_lower"))).otherwise(actual).alias("revenue_lower"),
        F.when(ahead, half_up(F.col("_upper"))).otherwise(actual).alias("revenue_upper"),
    )


def channel_contribution(forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded spend and revenue per channel with its share of the campaign's rounded spend."""
    rounded = (
        forecast.where(_history())
        .groupBy(*keys, "Channel")
        .agg(half_up(F.sum("Spend")).alias("spend"), half_up(F.sum("Revenue")).alias("revenue"))
    )
    whole = rounded.groupBy(*keys).agg(F.sum("spend").alias("_whole"))
    return attach(rounded, whole, keys, by=["Channel"]).select(
        *keys,
        "Channel",
        "spend",
        "revenue",
        ratio(F.col("spend").cast("double"), F.col("_whole").cast("double")).alias("spend_share"),
    )


def kpi_cards(summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Headline figures of a forecast summary."""
    return summary.select(
        *keys,
        F.col("projected_revenue"),
        pct_change(F.col("projected_revenue"), F.col("historical_revenue")).alias(
            "revenue_growth_pct"
        ),
        F.col("projected_roas"),
        (F.col("projected_roas") - F.col("historical_roas")).alias("roas_delta"),
        (F.col("projected_revenue") - F.col("projected_spend")).alias("projected_profit"),
        (F.col("historical_revenue") - F.col("historical_spend")).alias("historical_profit"),
        F.col("projected_spend"),
        F.col("historical_spend"),
    )


def rank_order(roas: str = "roas", channel: str = "Channel") -> list[Column]:
    """Best ROAS first. Ties follow a hash of the name: a fixed order that also spreads evenly."""
    return [F.desc(roas), tie_hash(channel).asc(), F.col(channel).asc()]


def rank_key(roas: str = "roas", channel: str = "Channel") -> Column:
    """The order of ``rank_order`` as one comparable value, smallest first."""
    return F.struct(-F.col(roas), tie_hash(channel), F.col(channel))


def rank_channels(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Position of each channel by ROAS; first is best, last is worst if there are several."""
    placed = running_totals(
        cut_evenly(df, keys, "roas", "Channel"),
        keys,
        bucket={name: F.col(name) for name in ("_bucket", "_tie")},
        order=rank_order(),
        position="rank",
        sums={},
    )
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_channels"))
    return (
        attach(placed, sizes, keys, by=["Channel"])
        .withColumns(
            {
                "is_best": F.col("rank") == 1,
                "is_worst": (F.col("rank") == F.col("_channels")) & (F.col("_channels") > 1),
            }
        )
        .drop("_channels")
    )


def best_channel(
    df: DataFrame, default: str = DEFAULT_CHANNEL, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Channel with the highest ROAS above zero per campaign, else ``default`` with ROAS 0."""
    above = F.col("roas") > 0
    first = F.min_by(F.struct("Channel", "roas"), F.when(above, rank_key()))
    return df.groupBy(*keys).agg(
        F.coalesce(first["Channel"], F.lit(default)).alias("best_channel"),
        F.coalesce(first["roas"], F.lit(0.0)).alias("best_roas"),
    )


def with_totals(
    df: DataFrame,
    sums: Sequence[str],
    keys: Sequence[str] = KEYS,
    label: str = "Total",
) -> DataFrame:
    """Channel rows plus one total row per key group: sums, and ROAS as the ratio of sums.

    The channel rows are passed through without a shuffle; only the totals are aggregated.
    """
    rows = df.select(*keys, "Channel", F.lit(False).alias("is_total"), *sums)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return join_totals(rows, totals, sums, keys, label)


def join_totals(
    rows: DataFrame, totals: DataFrame, sums: Sequence[str], keys: Sequence[str] = KEYS,
    label: str = "Total",
) -> DataFrame:
    """Channel rows and the total rows that belong to them in one table."""
    named = totals.select(
        *keys, F.lit(label).alias("Channel"), F.lit(True).alias("is_total"), *sums
    )
    return rows.unionByName(named).withColumn("ROAS", ratio(F.col("Revenue"), F.col("Spend")))
