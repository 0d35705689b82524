"""Questions about campaigns: intent by keyword, answer by template. Works on batch and stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.formats import money, ratio_x
from adlens.functions.numbers import first_match
from adlens.operators.spread import attach
from adlens.operators.summary import best_channel
from adlens.schema import DEFAULT_HISTORICAL_ROAS, DEFAULT_INTENT, INTENTS, KEYS


def intent(text: Column) -> Column:
    """First intent with a keyword in the text, upper and lower case alike."""
    low = F.lower(text)
    cases = []
    for name, words in INTENTS:
        hits = [F.contains(low, F.lit(word)) for word in words]
        cases.append((reduce(or_, hits), name))
    return first_match(cases, DEFAULT_INTENT)


def route_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("intent", intent(F.col(text)))


def answer_facts(
    summary: DataFrame, channel_rows: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """What the templates need, one row per campaign."""
    counts = channel_rows.groupBy(*keys).agg(F.count("*").alias("channels_count"))
    best = best_channel(channel_rows, keys=keys)
    return summary.join(best, list(keys), "left").join(counts, list(keys), "left")


def answer_messages(
    messages: DataFrame, facts: DataFrame, keys: Sequence[str] = KEYS, by: str = "message_id"
) -> DataFrame:
    """Answer of each message from the facts of its campaign."""
    joined = attach(route_messages(messages), facts, keys, by=[by])
    best = F.concat(F.coalesce("best_channel", F.lit("none")), F.lit(" at "),
                    ratio_x(F.coalesce("best_roas", F.lit(0.0))))
    history = ratio_x(F.coalesce("historical_roas", F.lit(DEFAULT_HISTORICAL_ROAS)))
    answer = (
        F.when(
            F.col("intent") == "allocation",
            F.concat(
                F.lit("Of "), F.coalesce("channels_count", F.lit(0)).cast("string"),
                F.lit(" channels "), best, F.lit(" returns most."),
            ),
        )
        .when(
            F.col("intent") == "forecast",
            F.concat(
                F.lit("Expected in 30 days: "),
                money(F.coalesce("projected_revenue", F.lit(0.0))), F.lit(" revenue, "),
                ratio_x(F.coalesce("projected_roas", F.lit(0.0))), F.lit(" return."),
            ),
        )
        .when(
            F.col("intent") == "return",
            F.concat(F.lit("Measured return: "), history, F.lit("; highest: "), best, F.lit(".")),
        )
        .otherwise("Topics: allocation, forecast, return.")
    )
    return joined.select(*keys, by, "intent", answer.alias("answer"))
