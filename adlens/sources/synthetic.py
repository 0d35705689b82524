"""Made-up campaigns for demonstrations and load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.numbers import half_up, half_up_tenth

# Channel, base spend, conversions per click, price per click, value per conversion.
CHANNELS = (
    ("Google Ads", 150.0, 0.04, 1.5, 120.0),
    ("Meta Ads", 200.0, 0.035, 1.2, 90.0),
    ("LinkedIn Ads", 80.0, 0.02, 4.5, 350.0),
    ("TikTok Ads", 120.0, 0.025, 0.8, 45.0),
)
DAYS = 60
WEEKEND_FACTOR = 0.7


def synth_campaigns(
    campaigns: DataFrame, last_date: str, days: int = DAYS, seed: int = 42
) -> DataFrame:
    """Facts of ``days`` days up to ``last_date`` over four channels for each given campaign.

    Noise is a hash of (seed, campaign, channel, date), so a row has the same values on every
    run, on any number of executors, and after a lost task.
    """
    channels = F.array(
        *[
            F.struct(
                F.lit(name).alias("Channel"), F.lit(base).alias("_base"), F.lit(rate).alias("_rate"),
                F.lit(price).alias("_price"), F.lit(value).alias("_value"),
            )
            for name, base, rate, price, value in CHANNELS
        ]
    )
    end = F.to_date(F.lit(last_date))
    cells = (
        campaigns.select("campaign_id")
        .withColumn("Date", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
        .select("campaign_id", "Date", F.inline(channels))
    )
    noise = F.md5(
        F.concat_ws("|", F.lit(str(seed)), "campaign_id", "Channel", F.date_format("Date", "yyyyMMdd"))
    )

    def uniform(draw: int) -> Column:
        """Number in [0, 1) from the draw-th six hex digits."""
        digits = F.substring("_noise", 1 + 6 * draw, 6)
        return F.conv(digits, 16, 10).cast("double") / float(16**6)

    def about(middle: float, width: float, draw: int) -> Column:
        return F.lit(middle - width / 2) + uniform(draw) * width

    weekend = F.when(F.weekday("Date") >= 5, WEEKEND_FACTOR).otherwise(1.0)
    return (
        cells.withColumn("_noise", noise)
        .withColumn("_day", half_up_tenth(F.col("_base") * about(1.0, 0.3, 0)))
        .withColumn("Spend", half_up_tenth(F.col("_day") * weekend))
        .withColumn("Clicks", half_up(F.col("Spend") / F.col("_price") * about(1.0, 0.2, 1)))
        .withColumn("Impressions", F.col("Clicks") * half_up(about(25.0, 20.0, 2)))
        .withColumn(
            "Conversions", half_up_tenth(F.col("Clicks") * F.col("_rate") * about(1.0, 0.4, 3))
        )
        .withColumn(
            "Revenue", half_up_tenth(F.col("Conversions") * F.col("_value") * about(1.0, 0.2, 4))
        )
        .select(
            "campaign_id",
            "Date",
            "Channel",
            "Spend",
            F.col("Impressions").cast("double").alias("Impressions"),
            F.col("Clicks").cast("double").alias("Clicks"),
            "Conversions",
            "Revenue",
        )
    )
