"""Campaign facts from general event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_as_facts(
    events: DataFrame, campaign: Column, channel: Column, grain: str = "day"
) -> DataFrame:
    """Facts per day or time stamp: views and clicks cost their value, purchases earn it.

    Money is summed as decimal, so sums do not depend on the order of rows.
    """
    kind = F.col("event_type")
    money = F.col("value").cast("decimal(18,2)")

    def total(wanted: Column) -> Column:
        return F.sum(F.when(wanted, money).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double")

    return events.groupBy(
        campaign.alias("campaign_id"),
        F.col("ts").cast("date" if grain == "day" else "timestamp").alias("Date"),
        channel.alias("Channel"),
    ).agg(
        total(kind.isin("view", "click")).alias("Spend"),
        (F.count_if(kind == "view") * 100).cast("double").alias("Impressions"),
        F.count_if(kind == "click").cast("double").alias("Clicks"),
        F.count_if(kind == "purchase").cast("double").alias("Conversions"),
        total(kind == "purchase").alias("Revenue"),
    )


def channel_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events, three campaigns of five channels."""
    user = F.col("user_id")
    return events_as_facts(
        table(spark, folder, "events"),
        F.concat(F.lit("c_"), (user % 3).cast("string")),
        F.concat(F.lit("ch_"), (user % 5).cast("string")),
    )


def stamped_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events, the same campaigns and channels with a row per time: many rows a day."""
    user = F.col("user_id")
    return events_as_facts(
        table(spark, folder, "events"),
        F.concat(F.lit("c_"), (user % 3).cast("string")),
        F.concat(F.lit("ch_"), (user % 5).cast("string")),
        "timestamp",
    )


def user_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Events, one channel per user: many series, many of them with days without spend."""
    user = F.col("user_id")
    return events_as_facts(
        table(spark, folder, "events"),
        F.concat(F.lit("c_"), (user % 10).cast("string")),
        F.concat(F.lit("u_"), user.cast("string")),
    )


def short_user_facts(spark: SparkSession, folder: str) -> DataFrame:
    """As ``user_facts``, but every tenth user starts a new channel every four days: short series,
    and channels that end on different dates."""
    user = F.col("user_id")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    period = F.when(user % 10 == 0, F.concat(F.lit("_"), F.floor(day / 4).cast("string")))
    return events_as_facts(
        table(spark, folder, "events"),
        F.concat(F.lit("c_"), (user % 3).cast("string")),
        F.concat(F.lit("u_"), user.cast("string"), F.coalesce(period, F.lit(""))),
    )


def segment_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines by market segment, a campaign per order status: a long history per
    channel."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("orders_"), "o_orderstatus").alias("campaign_id"),
        F.col("o_orderdate").cast("date").alias("Date"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    # Lines are summed per order first: the join then moves one row per order.
    per_order = lines.groupBy("o_orderkey").agg(
        F.sum(F.col("price") * F.col("discount")).alias("spend"),
        F.sum("l_quantity").alias("quantity"),
        F.count("*").alias("n_lines"),
        F.sum("price").alias("revenue"),
    )
    return (
        orders.join(per_order, "o_orderkey")
        .join(customers, "c_custkey")
        .groupBy("campaign_id", "Date", F.col("c_mktsegment").alias("Channel"))
        .agg(
            F.sum("spend").cast("double").alias("Spend"),
            F.sum("quantity").cast("double").alias("Impressions"),
            F.sum("n_lines").cast("double").alias("Clicks"),
            F.count("*").cast("double").alias("Conversions"),
            F.sum("revenue").cast("double").alias("Revenue"),
        )
    )


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events spoiled on purpose, as raw text rows: bad dates, odd channel names, currency signs,
    minus signs, missing tokens. Spend is a text column, clicks a numeric one."""
    event, user = F.col("event_id"), F.col("user_id")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
    number = (user % 5).cast("string")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.lit("dirty").alias("campaign_id"),
        F.col("event_id"),
        F.when(event % 97 == 0, "not a date")
        .when(event % 89 == 0, "06/02/2024")
        .otherwise(day)
        .alias("Date"),
        F.when(event % 53 == 0, F.lit(None).cast("string"))
        .when(event % 2 == 0, F.concat(F.lit("  web-"), number, F.lit("go ")))
        .otherwise(F.concat(F.lit("WEB-"), number, F.lit("GO")))
        .alias("Channel"),
        F.when(event % 31 == 0, "N/A")
        .when(event % 29 == 0, F.concat(F.lit("-"), value))
        .when(event % 7 == 0, F.concat(F.lit("$1,"), value))
        .otherwise(value)
        .alias("Spend"),
        F.when(kind == "view", "100").otherwise("0").alias("Impressions"),
        F.when(event % 29 == 0, "-5")
        .when(event % 31 == 0, "")
        .otherwise(user.cast("string"))
        .alias("Clicks"),
        F.when(kind == "purchase", "1").otherwise("0").alias("Conversions"),
        F.when(kind == "purchase", value).otherwise("0").alias("Revenue"),
    )


def dated_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw text rows of five campaigns with a date format each; every 41st date is in
    ISO form with a time, every 43rd no date at all."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ways = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "d/M/yyyy", "yyyy/M/d")
    day = F.date_format("ts", ways[0])
    for i, way in enumerate(ways[1:], 1):
        day = F.when(user % len(ways) == i, F.date_format("ts", way)).otherwise(day)
    return table(spark, folder, "events").select(
        F.concat(F.lit("way_"), (user % len(ways)).cast("string")).alias("campaign_id"),
        F.when(event % 41 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(event % 43 == 0, "no date")
        .otherwise(day)
        .alias("Date"),
        F.concat(F.lit("Ch "), (event % 4).cast("string")).alias("Channel"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("Spend"),
        *[F.when(kind == name, "1").otherwise("0").alias(column)
          for name, column in (("view", "Impressions"), ("click", "Clicks"),
                               ("purchase", "Conversions"))],
        F.lit("1").alias("Revenue"),
    )
