"""Rule-based diagnostics of campaigns and channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.numbers import first_match, pct_change
from adlens.operators.spread import attach
from adlens.operators.summary import rank_key
from adlens.schema import (
    BASIC_TIERS, CONCENTRATION_SHARE, HEALTHY_ROAS, KEYS, SATURATION_ROAS, SATURATION_SPEND,
    STABLE_BAND, STEADY_GROWTH_PCT, TIERS,
)

NO_CHANNEL = "None"


def trend(summary: DataFrame) -> DataFrame:
    """Trend label, growth figures and portfolio health of a forecast summary.

    The stable band only catches small losses: any gain at all counts as improving.
    """
    new, old = F.col("projected_roas"), F.col("historical_roas")
    growth = pct_change(F.col("projected_revenue"), F.col("historical_revenue"))
    label = (
        F.when(new > old, "improving")
        .when(F.abs(new - old) < STABLE_BAND, "stable")
        .otherwise("declining")
    )
    return summary.withColumns(
        {
            "trend": label,
            "revenue_growth_pct": growth,
            "spend_growth_pct": pct_change(F.col("projected_spend"), F.col("historical_spend")),
            "is_healthy": new >= HEALTHY_ROAS,
            "growth_label": F.when(growth > STEADY_GROWTH_PCT, "steady growth").otherwise(
                "marginal returns"
            ),
        }
    )


_LEVELS = {"full": TIERS, "basic": BASIC_TIERS}
_ACTIONS = {
    "full": ("scale", "maintain", "monitor", "reduce"),
    "basic": ("scale", "maintain", "cap"),
}


def channel_tiers(df: DataFrame, style: str = "full") -> DataFrame:
    """Efficiency tier and recommended action per channel: four levels, or three (``basic``)."""
    levels, actions = _LEVELS[style], _ACTIONS[style]
    reached = [F.col("roas") >= bound for bound, _ in levels[:-1]]
    labels = [label for _, label in levels]
    return df.withColumns(
        {
            "tier": first_match(zip(reached, labels), labels[-1]),
            "action": first_match(zip(reached, actions), actions[-1]),
        }
    )


def best_and_worst(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last channel by ROAS per campaign; a single channel is never the worst."""
    entry = F.struct("Channel", "roas", "spend")
    found = df.groupBy(*keys).agg(
        F.min_by(entry, rank_key()).alias("_best"),
        F.max_by(entry, rank_key()).alias("_worst"),
        F.count("*").alias("_channels"),
    )
    several = F.col("_channels") > 1
    return found.select(
        *keys,
        F.col("_best.Channel").alias("best_channel"),
        F.col("_best.roas").alias("best_roas"),
        F.col("_best.spend").alias("best_spend"),
        F.when(several, F.col("_worst.Channel")).alias("worst_channel"),
        F.when(several, F.col("_worst.roas")).alias("worst_roas"),
    )


def _extremes(summary: DataFrame, channel_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary rows with best and worst channel; campaigns without channels are kept."""
    found = best_and_worst(channel_rows, keys)
    fill = {"best_channel": NO_CHANNEL, "worst_channel": NO_CHANNEL,
            "best_roas": 0.0, "worst_roas": 0.0, "best_spend": 0.0}
    return summary.join(found, list(keys), "left").fillna(fill)


def risk_flags(
    summary: DataFrame, channel_rows: DataFrame, keys: Sequence[str] = KEYS, style: str = "full"
) -> DataFrame:
    """Is the best channel saturating, and does it hold too much of the historical spend?"""
    spend = F.col("best_spend")
    saturated = spend > SATURATION_SPEND
    if style == "full":
        saturated = saturated & (F.col("best_roas") > SATURATION_ROAS)
    return _extremes(summary, channel_rows, keys).select(
        *keys,
        "best_channel",
        "best_roas",
        "best_spend",
        saturated.alias("is_saturating"),
        (spend > F.col("historical_spend") * CONCENTRATION_SHARE).alias("is_concentrated"),
    )


def shift_plan(
    summary: DataFrame, channel_rows: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Where budget should move: from the worst to the best channel by ROAS."""
    return _extremes(summary, channel_rows, keys).select(
        *keys,
        F.col("worst_channel").alias("from_channel"),
        F.col("worst_roas").alias("from_roas"),
        F.col("best_channel").alias("to_channel"),
        F.col("best_roas").alias("to_roas"),
    )


def scenario_verdict(
    totals: DataFrame, summary: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Scenario ROAS against the projected ROAS of its campaign."""
    uplift = pct_change(F.col("TotalROAS"), F.col("projected_roas"))
    known = summary.select(*keys, "projected_roas")
    return attach(totals, known, keys, by=["scenario_id"], how="inner").select(
        *keys,
        "scenario_id",
        "TotalSpend",
        "TotalRevenue",
        "TotalROAS",
        "projected_roas",
        uplift.alias("uplift_pct"),
        (uplift > 0).alias("improves"),
    )
