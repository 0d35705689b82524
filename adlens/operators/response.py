"""Response curves, what-if scenarios and the best split of a budget.

Model per channel and metric: metric = alpha * ln(1 + daily spend), least squares through 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numbers import half_up, not_negative, ratio
from adlens.operators.spread import attach, cut_evenly, running_totals, tie_hash
from adlens.operators.summary import daily, join_totals, with_totals
from adlens.schema import (
    GRID_DEFAULT_SPEND, GRID_MIN_LIMIT, GRID_SPEND_FACTOR, GRID_STEP, KEYS,
)
from adlens.session import durable

#: Curves and the measure each is fitted to.
ALPHAS = {
    "alpha_rev": "Revenue",
    "alpha_conv": "Conversions",
    "alpha_clicks": "Clicks",
    "alpha_imp": "Impressions",
}


def fit_curves(df: DataFrame, keys: Sequence[str] = KEYS, merged: bool = False) -> DataFrame:
    """Four alphas and three daily averages per channel, as one algebraic aggregate.

    ``merged=True``: the input already has one row per (Date, Channel), as cleaning leaves it, and
    the daily merge with its shuffle is left out.
    """
    days = df if merged else daily(df, keys)
    log_spend = F.log1p(F.col("Spend"))
    sums = days.groupBy(*keys, "Channel").agg(
        F.sum(log_spend * log_spend).alias("_squares"),
        *[F.sum(F.col(y) * log_spend).alias(f"_{a}") for a, y in ALPHAS.items()],
        F.avg("Spend").alias("avg_spend"),
        F.avg("Revenue").alias("avg_revenue"),
        F.avg("Conversions").alias("avg_conversions"),
    )
    averages = {c: F.col(c) for c in ("avg_spend", "avg_revenue", "avg_conversions")}
    return curve_of_sums(sums, F.col("_squares"), {a: F.col(f"_{a}") for a in ALPHAS}, averages, keys)


def curve_of_sums(
    sums: DataFrame, squares: Column, products: dict[str, Column], averages: dict[str, Column],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Alphas from the sums of squares and products, with the averages, per channel."""
    alphas = [not_negative(ratio(top, squares)).alias(a) for a, top in products.items()]
    return sums.select(*keys, "Channel", *alphas, *[c.alias(n) for n, c in averages.items()])


def _outcome(spend: Column) -> dict[str, Column]:
    log_spend = F.log1p(spend)
    return {
        "Spend": spend,
        "Impressions": F.col("alpha_imp") * log_spend,
        "Clicks": F.col("alpha_clicks") * log_spend,
        "Conversions": F.col("alpha_conv") * log_spend,
        "Revenue": F.col("alpha_rev") * log_spend,
    }


def _evaluate(rows: DataFrame, spend: Column, kept: Sequence[str]) -> DataFrame:
    metrics = rows.select(*kept, *[c.alias(n) for n, c in _outcome(spend).items()])
    return metrics.select(
        "*",
        ratio(F.col("Revenue"), F.col("Spend")).alias("ROAS"),
        ratio(F.col("Spend"), F.col("Conversions")).alias("CPA"),
        ratio(F.col("Spend"), F.col("Clicks")).alias("CPC"),
        ratio(F.col("Clicks"), F.col("Impressions")).alias("CTR"),
    )


def check_budgets(budgets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One budget per channel of a scenario; the query fails on a negative or a second one."""
    negative = F.raise_error(F.concat(F.lit("budget below 0 for channel "), F.col("Channel")))
    twice = F.raise_error(F.concat(F.lit("more than one budget for channel "), F.col("Channel")))
    rows = budgets.groupBy(*keys, "scenario_id", "Channel").agg(
        F.min("budget").alias("budget"), F.count("*").alias("_n")
    )
    checked = (
        F.when((F.col("_n") > 1) & F.col("Channel").isNotNull(), twice.cast("double"))
        .when(F.col("budget") < 0, negative.cast("double"))
        .otherwise(F.col("budget"))
    )
    return rows.select(*keys, "scenario_id", "Channel", checked.alias("budget"))


def check_totals(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """One total per campaign (and scenario); the query fails on a second one."""
    twice = F.raise_error(F.lit("more than one total budget for a campaign; name scenarios"))
    rows = totals.groupBy(*by).agg(F.min("total_budget").alias("total_budget"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > 1, twice.cast("double")).otherwise(F.col("total_budget"))
    return rows.select(*by, checked.alias("total_budget"))


def simulate(curves: DataFrame, budgets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcome of every scenario for every channel of its campaign.

    ``budgets``: (campaign, scenario_id, Channel, budget). A channel without a budget keeps its
    average spend, a budget for an unknown channel is ignored (see ``unmatched_budgets``), a
    scenario that names no known channel still yields all channels.
    """
    checked = check_budgets(budgets, keys)
    scenarios = checked.select(*keys, "scenario_id").distinct()
    every = attach_scenarios(curves, scenarios, keys)
    given = checked.select(*keys, "scenario_id", "Channel", F.col("budget").alias("_budget"))
    rows = every.join(given, [*keys, "scenario_id", "Channel"], "left")
    spend = F.coalesce(F.col("_budget"), F.col("avg_spend"))
    return _evaluate(rows, spend, [*keys, "scenario_id", "Channel"])


def usual_scenario(
    curves: DataFrame, scenario_id: str = "usual", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Budgets that name no channel: every channel keeps its average spend."""
    return curves.select(*keys).distinct().select(
        *keys,
        F.lit(scenario_id).alias("scenario_id"),
        F.lit(None).cast("string").alias("Channel"),
        F.lit(None).cast("double").alias("budget"),
    )


def attach_scenarios(
    curves: DataFrame, scenarios: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One curve row per scenario of its campaign; this is the size of the simulation result."""
    return attach(curves, scenarios, keys, by=["Channel"], how="inner")


def unmatched_budgets(
    curves: DataFrame, budgets: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Budgets for channels that have no curve (names are compared with their exact case)."""
    known = curves.select(*keys, "Channel")
    return attach(budgets, known, [*keys, "Channel"], by=["scenario_id"], how="left_anti")


def scenario_totals(simulated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals per scenario; ROAS is the ratio of the sums."""
    return (
        simulated.groupBy(*keys, "scenario_id")
        .agg(
            F.sum("Spend").alias("TotalSpend"),
            F.sum("Revenue").alias("TotalRevenue"),
            F.sum("Conversions").alias("TotalConversions"),
        )
        .withColumn("TotalROAS", ratio(F.col("TotalRevenue"), F.col("TotalSpend")))
    )


def totals_of_budgets(
    curves: DataFrame, budgets: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``scenario_totals`` of ``simulate`` without a row per scenario and channel.

    A scenario differs from the average spend only where it names a channel. The totals at average
    spend are taken once per campaign, and each budget adds its difference, so the work grows with
    the budgets and not with scenarios times channels.
    """
    measures = ("Spend", "Revenue", "Conversions")
    ks = list(keys)
    checked = check_budgets(budgets, keys)
    usual = _outcome(F.col("avg_spend"))
    per_campaign = curves.groupBy(*ks).agg(*[F.sum(usual[m]).alias(f"_usual_{m}") for m in measures])
    chosen = _outcome(F.col("budget"))
    known = curves.select(*ks, "Channel", "alpha_rev", "alpha_conv", "alpha_clicks", "alpha_imp",
                          "avg_spend")
    named = attach(checked, known, [*ks, "Channel"], by=["scenario_id"])
    # A budget for a channel without a curve changes nothing, but its scenario counts.
    changes = named.groupBy(*ks, "scenario_id").agg(
        *[F.coalesce(F.sum(chosen[m] - usual[m]), F.lit(0.0)).alias(f"_change_{m}")
          for m in measures]
    )
    totals = attach(changes, per_campaign, ks, by=["scenario_id"], how="inner").select(
        *ks,
        "scenario_id",
        *[(F.col(f"_usual_{m}") + F.col(f"_change_{m}")).alias(f"Total{m}") for m in measures],
    )
    return totals.withColumn("TotalROAS", ratio(F.col("TotalRevenue"), F.col("TotalSpend")))


def with_scenario_totals(
    simulated: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Channel rows and the total row of each scenario in one table."""
    measures = ("Spend", "Conversions", "Revenue")
    ks = [*keys, "scenario_id"]
    rows = simulated.select(*ks, "Channel", F.lit(False).alias("is_total"), *measures)
    named = totals.select(*ks, *[F.col(f"Total{m}").alias(m) for m in measures])
    return join_totals(rows, named, measures, ks)


def baseline(curves: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Historical daily averages per channel and their total; ROAS is a ratio of averages."""
    averages = curves.select(
        *keys,
        "Channel",
        F.col("avg_spend").alias("Spend"),
        F.col("avg_conversions").alias("Conversions"),
        F.col("avg_revenue").alias("Revenue"),
    )
    return with_totals(averages, ("Spend", "Conversions", "Revenue"), keys)


def compare(simulated: DataFrame, base: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded spend and revenue of each scenario channel next to the baseline (0 if none)."""
    known = base.where(~F.col("is_total")).select(
        *keys, "Channel", F.col("Spend").alias("_spend"), F.col("Revenue").alias("_revenue")
    )
    zero = F.lit(0.0)
    return attach(simulated, known, [*keys, "Channel"], by=["scenario_id"]).select(
        *keys,
        "scenario_id",
        "Channel",
        half_up(F.coalesce("_spend", zero)).alias("base_spend"),
        half_up(F.col("Spend")).alias("simulated_spend"),
        half_up(F.coalesce("_revenue", zero)).alias("base_revenue"),
        half_up(F.col("Revenue")).alias("simulated_revenue"),
    )


def optimize(curves: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Split of a total daily budget that maximises the sum of alpha_i * ln(1 + x_i).

    ``totals``: (campaign, total_budget), one row per campaign, or (campaign, scenario_id,
    total_budget) with several; each split then stands under its scenario. With n and S of
    ``split_levels`` a channel gets max(0, (alpha * (B + n) - S) / S), which sums to B as it
    stands. All alphas 0: equal split; B <= 0: all 0.
    """
    ks, split = _split(curves.select(*keys, "Channel", "alpha_rev"), totals, keys)
    return split.select(*ks, "Channel", "total_budget", "_budget").withColumnRenamed("_budget", "budget")


def ladder(curves: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The budget from which each channel takes part in the best split of its campaign.

    With channels in descending alpha and S_k the running sum, channel k takes part exactly while
    alpha_k > S_k / (B + k), which is B > S_k / alpha_k - k. That ``threshold`` never falls along
    the order, so one ladder per campaign answers every budget. (campaign, Channel, k, alphas,
    threshold, and the buckets of the order); channels with alpha 0 have no threshold.
    """
    ordered = cut_evenly(curves.select(*keys, "Channel", "alpha_rev"), keys, "alpha_rev", "Channel")
    steps = running_totals(
        ordered.withColumns({"_cut": F.col("_bucket"), "_part": F.col("_tie")}),
        keys,
        bucket={name: F.col(name) for name in ("_bucket", "_tie")},
        order=[F.desc("alpha_rev"), tie_hash("Channel").asc(), F.col("Channel")],
        position="k",
        sums={"alphas": F.col("alpha_rev")},
    )
    threshold = F.when(F.col("alpha_rev") > 0, F.col("alphas") / F.col("alpha_rev") - F.col("k"))
    return steps.withColumn("threshold", threshold)


def split_levels(
    curves: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """How far down the ladder each total reaches: (campaign, scenario_id, total_budget, channels,
    n, sum), the number of channels that take part and the sum of their alphas.

    The last step below the budget is looked up, first among the first steps of the buckets (a
    small list per campaign), then inside that bucket, where budgets and steps meet in one order.
    Work is the ladder once plus the totals; channels and totals are never multiplied. Different
    scenarios with one budget are looked up once.
    """
    campaign = list(keys)
    by = [*campaign, *(c for c in ("scenario_id",) if c in totals.columns)]
    checked = check_totals(totals, by)
    steps = durable(ladder(curves, keys).select(*campaign, "_cut", "_part", "k", "alphas", "threshold"))
    sizes = steps.groupBy(*campaign).agg(F.count("*").alias("channels"))
    # Steps in order: high cuts first, and inside equal values high parts first.
    cuts = (
        steps.where("threshold IS NOT NULL")
        .groupBy(*campaign, "_cut", "_part")
        .agg(F.min("threshold").alias("_from"))
        .groupBy(*campaign)
        .agg(F.array_sort(F.collect_list(F.struct("_from", (-F.col("_cut")).alias("_cut"),
                                                  (-F.col("_part")).alias("_part")))).alias("_cuts"))
    )
    budgets = checked.select(*campaign, "total_budget").distinct()
    reached = F.filter("_cuts", lambda c: c["_from"] < F.col("total_budget"))
    placed = attach(budgets, cuts, campaign, by=["total_budget"], how="inner").select(
        *campaign, "total_budget", F.get(reached, F.size(reached) - 1).alias("_c")
    ).where("_c IS NOT NULL")
    asked = placed.select(
        *campaign, (-F.col("_c._cut")).alias("_cut"), (-F.col("_c._part")).alias("_part"),
        F.col("total_budget").alias("_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast("struct<n:bigint,sum:double>").alias("_level"),
    )
    known = steps.where("threshold IS NOT NULL").select(
        *campaign, "_cut", "_part", F.col("threshold").alias("_at"), F.lit(1).alias("_kind"),
        F.struct(F.col("k").alias("n"), F.col("alphas").alias("sum")).alias("_level"),
    )
    inside = Window.partitionBy(*campaign, "_cut", "_part").orderBy("_at", "_kind", "_level.n")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = (
        known.unionByName(asked)
        .withColumn("_level", F.last("_level", ignorenulls=True).over(so_far))
        .where("_kind = 0")
        .select(*campaign, F.col("_at").alias("total_budget"), "_level.*")
    )
    answered = attach(checked, answers, [*campaign, "total_budget"], by=by)
    return attach(answered, sizes, campaign, by=by, how="inner")


def _split(
    curves: DataFrame, totals: DataFrame, keys: Sequence[str]
) -> tuple[list[str], DataFrame]:
    """The curves with the ``_budget`` of the best split, and the columns that name a split."""
    campaign = list(keys)
    ks = [*campaign, *(c for c in ("scenario_id",) if c in totals.columns)]
    budget, alpha = F.col("total_budget"), F.col("alpha_rev")
    n, total = F.col("_n"), F.col("_sum")
    share = (
        F.when(budget <= 0, 0.0)
        .when(total.isNull(), budget / F.col("_channels"))
        .otherwise(not_negative((alpha * budget + (alpha * n - total)) / total))
    )
    levels = split_levels(curves, totals, keys).select(
        *ks, "total_budget", F.col("channels").alias("_channels"), F.col("n").alias("_n"), F.col("sum").alias("_sum")
    )
    # One row per split carries its budget and level: the curves meet it once.
    paid = attach(curves, levels, campaign, by=["Channel"], how="inner")
    return ks, paid.withColumn("_budget", share)


def optimize_and_simulate(
    curves: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The best split with the outcome it is expected to have."""
    ks, split = _split(curves, totals, keys)
    return _evaluate(split, F.col("_budget"), [*ks, "Channel", "total_budget"])


def split_as_budgets(
    split: DataFrame, scenario_id: str = "optimized", keys: Sequence[str] = KEYS
) -> DataFrame:
    """An optimal split as a scenario in whole units of budget, the way it is entered by hand."""
    return split.select(
        *keys,
        F.lit(scenario_id).alias("scenario_id"),
        "Channel",
        half_up(F.col("budget")).cast("double").alias("budget"),
    )


def default_total(curves: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The default total budget per campaign: the rounded sum of average spends."""
    return curves.groupBy(*keys).agg(
        half_up(F.sum("avg_spend")).cast("double").alias("total_budget")
    )


def default_budgets(curves: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded average spend per channel; the total rounds the sum of the unrounded ones."""
    return baseline(curves, keys).select(
        *keys, "Channel", "is_total", half_up(F.col("Spend")).alias("budget")
    )


def budget_grid(curves: DataFrame, keys: Sequence[str] = KEYS, step: int = GRID_STEP) -> DataFrame:
    """Expected outcome along the search range 0, 10, 20, ... of every channel.

    The range ends at three times the rounded average spend (100 if there is none), 5000 at least.
    It is laid out in two steps so that no single array grows with the spend.
    """
    base = half_up(F.when(F.col("avg_spend") > 0, F.col("avg_spend"))
                   .otherwise(F.lit(float(GRID_DEFAULT_SPEND))))
    limit = F.greatest(base * GRID_SPEND_FACTOR, F.lit(GRID_MIN_LIMIT))
    wide = F.lit(step * 1000).cast("bigint")
    blocks = curves.withColumn("_limit", limit.cast("bigint")).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_limit"), wide))
    )
    until = F.least(F.col("_from") + wide - step, F.col("_limit"))
    points = blocks.withColumn(
        "_budget", F.explode(F.sequence(F.col("_from"), until, F.lit(step).cast("bigint")))
    )
    outcome = _outcome(F.col("_budget").cast("double"))
    return points.select(
        *keys,
        "Channel",
        F.col("_budget").alias("budget"),
        outcome["Revenue"].alias("Revenue"),
        outcome["Conversions"].alias("Conversions"),
    )
