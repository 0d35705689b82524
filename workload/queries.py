"""Spark side of the checked queries: every one reads whole tables of the given folder.

Doubles are rounded and whole numbers widened at the very end, so that both engines can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import canonical_channel
from adlens.operators import (
    cleaning as cl,
    diagnose as dx,
    features as ft,
    forecast as fc,
    forecast_rows as fr,
    messages as ms,
    narrative as nv,
    reports as rp,
    response as rc,
    summary as sm,
)
from adlens.schema import MEASURES
from adlens.session import durable
from adlens.sources import adapters as ad
from adlens.sources import catalog as ct
from adlens.sources import files as fl
from adlens.sources import synthetic as sy
from workload import stored

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles (no negative zero) and 64-bit whole numbers.

    Averages of cents often lie on a half of the last digit, where the order of a sum would decide
    the rounding; the boundary is therefore put beside the half. Values stay doubles throughout:
    no whole-number type clamps large ones.
    """
    scale = float(10**digits)
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            col = F.rint(col * scale - 0.01) / scale + 0.0
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        columns.append(col.alias(field.name))
    return df.select(*columns)


# ---- shared inputs


def user_features(spark: SparkSession, folder: str) -> DataFrame:
    return ft.engineer_features(ad.user_facts(spark, folder))


def short_features(spark: SparkSession, folder: str) -> DataFrame:
    return ft.with_calendar(ft.with_kpis(ad.short_user_facts(spark, folder)))


def flat_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return fc.forecast_all_flat(short_features(spark, folder))


def user_channel_rows(spark: SparkSession, folder: str) -> DataFrame:
    history = fc.history_as_forecast(ft.with_kpis(ad.user_facts(spark, folder)))
    return sm.channel_summary(history)


def channel_curves(spark: SparkSession, folder: str) -> DataFrame:
    return durable(rc.fit_curves(ad.channel_facts(spark, folder), merged=True))


def user_curves(spark: SparkSession, folder: str) -> DataFrame:
    return durable(rc.fit_curves(ad.user_facts(spark, folder), merged=True))


def supplier_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """One scenario per supplier; two of seven name a channel that does not exist."""
    key = F.col("s_suppkey")
    return ad.table(spark, folder, "supplier").select(
        F.concat(F.lit("c_"), (key % 3).cast("string")).alias("campaign_id"),
        F.col("s_name").alias("scenario_id"),
        F.concat(F.lit("ch_"), (key % 7).cast("string")).alias("Channel"),
        F.abs(F.col("s_acctbal")).alias("budget"),
    )


def simulated(spark: SparkSession, folder: str) -> DataFrame:
    return rc.simulate(channel_curves(spark, folder), supplier_budgets(spark, folder))


def stored_short(spark: SparkSession, folder: str) -> DataFrame:
    """The daily facts behind a summary and its channel rows, stored: the events are read once."""
    return durable(short_features(spark, folder))


def summary_and_channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    daily = stored_short(spark, folder)
    summary = sm.forecast_summary(fc.forecast_all_flat(daily))
    return summary, sm.channel_summary(fc.history_as_forecast(daily))


def flat_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sm.forecast_summary(flat_forecast(spark, folder))


def short_channel_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sm.channel_summary(fc.history_as_forecast(short_features(spark, folder)))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages; four of five get a question put behind their text."""
    pick = (F.col("conv_id") + F.col("turn")) % 5
    question = (
        F.when(pick == 0, " Optimize my BUDGET forecast")
        .when(pick == 1, " What about next month ROAS?")
        .when(pick == 2, " Which return do I get?")
        .when(pick == 3, " Which channel should I invest in?")
        .otherwise("")
    )
    return ad.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.concat(F.lit("c_"), (F.col("conv_id") % 3).cast("string")).alias("campaign_id"),
        F.concat("text", question).alias("text"),
    )


# ---- queries


def kpi_ratios(spark, folder):
    return ft.with_kpis(ad.channel_facts(spark, folder))


def calendar_features(spark, folder):
    dated = ft.with_model_features(ft.with_calendar(ad.segment_facts(spark, folder)))
    return dated.select("campaign_id", "Channel", "Date", "Month", "Quarter", "HolidayFlag",
                        "Ordinal", "DayOfWeek", "DayOfMonth")


def rolling_lag(spark, folder):
    return user_features(spark, folder).select(
        "campaign_id", "Channel", "Date", "Spend_MA7", "ROAS_MA7", "Spend_Lag7", "Revenue_Lag7"
    )


def featured_long_history(spark, folder):
    return ft.engineer_features(ad.segment_facts(spark, folder))


def dataset_summary(spark, folder):
    return sm.dataset_summary(ad.channel_facts(spark, folder))


def channel_list(spark, folder):
    return sm.channels(ad.user_facts(spark, folder))


def daily_totals(spark, folder):
    last_digit = F.substring("Channel", -1, 1)
    return sm.daily(ad.user_facts(spark, folder).withColumn("Channel", last_digit))


def preview_rows(spark, folder):
    return fl.preview(ad.channel_facts(spark, folder))


def iso_records(spark, folder):
    return fl.to_records(ad.channel_facts(spark, folder))


def clean_dates(spark, folder):
    return cl.parse_dates(ad.dirty_events(spark, folder)).select("event_id", "Date")


def clean_channel(spark, folder):
    return ad.dirty_events(spark, folder).select(
        "event_id", canonical_channel(F.col("Channel")).alias("Channel")
    )


def clean_numeric(spark, folder):
    return cl.clean_numeric(ad.dirty_events(spark, folder)).select("event_id", *MEASURES)


def clean_numeric_strict(spark, folder):
    return cl.clean_numeric(ad.dirty_events(spark, folder), mode="strict").select(
        "event_id", *MEASURES
    )


def _clean_rows(spark, folder):
    raw = ad.dirty_events(spark, folder)
    rows = cl.clean_numeric(cl.parse_dates(raw), typed_by=raw)
    return rows.withColumn("Channel", canonical_channel(F.col("Channel")))


def duplicate_count(spark, folder):
    return cl.duplicate_count(_clean_rows(spark, folder))


def merge_duplicates(spark, folder):
    return cl.merge_duplicates(_clean_rows(spark, folder))


def clean_facts(spark, folder):
    return cl.clean(ad.dirty_events(spark, folder))


def clean_stored_profile(spark, folder):
    return cl.facts_of_profile(durable(cl.profile(ad.dirty_events(spark, folder))))


def cleaning_audit(spark, folder):
    return cl.cleaning_audit(ad.dirty_events(spark, folder))


def last_row(spark, folder):
    return sm.last_row(ft.with_kpis(ad.user_facts(spark, folder)))


def last30_dates(spark, folder):
    return sm.last_n_dates(durable(ad.segment_facts(spark, folder)))


def future_calendar(spark, folder):
    return fc.future_calendar(ad.short_user_facts(spark, folder))


def forecast_flat(spark, folder):
    return fc.forecast_flat(short_features(spark, folder))


def forecast_forest(spark, folder):
    return fc.forecast_forest(short_features(spark, folder))


def forecast_forest_nodes(spark, folder):
    """Forests stored as a node table, walked by expressions for the dates ahead."""
    history = short_features(spark, folder)
    nodes = durable(fc.forest_nodes(history))
    return fc.prediction_bounds(fc.score_nodes(nodes, fc.future_calendar(history)))


def forecast_all(spark, folder):
    """History, flat and forest rows with the 90 % band."""
    return fc.forecast(short_features(spark, folder), level=0.90)


def forecast_skeleton(spark, folder):
    return fc.forecast(short_features(spark, folder)).select(
        "campaign_id", "Channel", "Date", "IsForecast"
    )


def _kept_by_forests(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """What every forest must keep: its dates, the order of its band, the range of its history."""
    ids = ["campaign_id", "Channel"]
    known = history.groupBy(*ids).agg(
        *[F.min(c).alias(f"_low_{c}") for c in MEASURES],
        *[F.max(c).alias(f"_high_{c}") for c in MEASURES],
    )
    ordered = F.lit(True)
    for c in ("Revenue", "Conversions"):
        ordered &= (F.col(f"{c}_Lower") <= F.col(c)) & (F.col(c) <= F.col(f"{c}_Upper"))
    inside = F.lit(True)
    for c in MEASURES:
        room = F.col(f"_high_{c}") * 1e-9 + 1e-9
        inside &= F.col(c).between(F.col(f"_low_{c}") - room, F.col(f"_high_{c}") + room)
    return (
        forecast.join(known, ids)
        .groupBy(*ids)
        .agg(
            F.count("*").alias("days"),
            F.min("Date").alias("first"),
            F.max("Date").alias("last"),
            F.every(ordered).alias("band_in_order"),
            F.every(inside).alias("in_range"),
        )
    )


def forecast_forest_checks(spark, folder):
    history = short_features(spark, folder)
    return _kept_by_forests(fc.forecast_forest(history), history)


def forecast_rows_checks(spark, folder):
    """The same of channels with many rows a day."""
    history = ad.stamped_facts(spark, folder)
    return _kept_by_forests(fc.prediction_bounds(fr.forest_stats_of_rows(history)), history)


def daily_draws(spark, folder):
    """The sums that forests over rows are grown from, of the tree that takes every row."""
    drawn = fr.daily_draws(ad.stamped_facts(spark, folder))
    whole = drawn.where(F.col("_tree") == fr.ALL_ROWS).drop("_tree")
    return whole.withColumnRenamed("_drawn", "n_rows")


def _vector_trees(spark, folder):
    """Vectors of the embeddings table take the place of tree predictions."""
    vector = F.col("embedding").cast("array<double>")

    def line(scale: float, offset: float):
        return F.transform(vector, lambda x: x * scale + offset)

    return ad.table(spark, folder, "embeddings").select(
        F.concat(F.lit("l_"), F.col("label").cast("string")).alias("campaign_id"),
        F.concat(F.lit("v_"), F.col("vec_id").cast("string")).alias("Channel"),
        F.lit("2024-02-01").cast("date").alias("Date"),
        *[
            line(scale, offset).alias(f"{c}_trees")
            for c, scale, offset in zip(MEASURES, (100.0, 50.0, 10.0, 5.0, 200.0),
                                        (1.0, 0.0, 0.5, 0.25, 2.0))
        ],
    )


def prediction_bounds(spark, folder):
    return fc.prediction_bounds(fc.tree_stats(_vector_trees(spark, folder)), 0.90)


def prediction_bounds_default(spark, folder):
    return fc.prediction_bounds(fc.tree_stats(_vector_trees(spark, folder)))


def prediction_bounds_other(spark, folder):
    """A level without a z of its own."""
    return fc.prediction_bounds(fc.tree_stats(_vector_trees(spark, folder)), 0.80)


def history_rows(spark, folder):
    return fc.history_as_forecast(short_features(spark, folder))


def projected_summary(spark, folder):
    return sm.projected_summary(flat_forecast(spark, folder))


def historical_summary(spark, folder):
    return sm.historical_summary(
        fc.history_as_forecast(ft.with_kpis(durable(ad.segment_facts(spark, folder))))
    )


def forecast_summary(spark, folder):
    return flat_summary(spark, folder)


def kpi_cards(spark, folder):
    return sm.kpi_cards(flat_summary(spark, folder))


def daily_actual_vs_forecast(spark, folder):
    return sm.daily_actual_vs_forecast(flat_forecast(spark, folder))


def channel_summary(spark, folder):
    return short_channel_rows(spark, folder)


def contribution_share(spark, folder):
    return sm.channel_contribution(fc.history_as_forecast(stored_short(spark, folder)))


def fit_curves(spark, folder):
    return rc.fit_curves(ad.segment_facts(spark, folder))


def fit_curves_many_series(spark, folder):
    return rc.fit_curves(ad.user_facts(spark, folder), merged=True)


def simulate(spark, folder):
    return simulated(spark, folder)


def scenario_totals(spark, folder):
    return rc.scenario_totals(simulated(spark, folder))


def scenario_totals_direct(spark, folder):
    return rc.totals_of_budgets(channel_curves(spark, folder), supplier_budgets(spark, folder))


def scenario_rollup(spark, folder):
    curves, budgets = channel_curves(spark, folder), supplier_budgets(spark, folder)
    return rc.with_scenario_totals(
        rc.simulate(curves, budgets), rc.totals_of_budgets(curves, budgets)
    )


def unmatched_budgets(spark, folder):
    return rc.unmatched_budgets(channel_curves(spark, folder), supplier_budgets(spark, folder))


def baseline(spark, folder):
    return rc.baseline(channel_curves(spark, folder))


def scenario_compare(spark, folder):
    curves = channel_curves(spark, folder)
    outcome = rc.simulate(curves, supplier_budgets(spark, folder))
    return rc.compare(outcome, rc.baseline(curves))


def optimize(spark, folder):
    curves = user_curves(spark, folder)
    return rc.optimize(curves, rc.default_total(curves))


def optimize_scenarios(spark, folder):
    """Several totals per campaign, each split under its scenario."""
    curves = channel_curves(spark, folder)
    named = F.explode(F.array(*(
        F.struct(F.lit(name).alias("scenario_id"), F.lit(total).alias("total_budget"))
        for name, total in (("low", 100.0), ("high", 5000.0))
    )))
    totals = curves.select("campaign_id").distinct().select("campaign_id", named.alias("t"))
    return rc.optimize(curves, totals.select("campaign_id", "t.*"))


def optimize_many_totals(spark, folder):
    """Hundreds of totals per campaign, one scenario for each part; some are zero or below."""
    price = F.col("p_retailprice") * (F.col("p_partkey") % 50 - 1)
    totals = ad.table(spark, folder, "part").select(
        F.concat(F.lit("c_"), (F.col("p_partkey") % 3).cast("string")).alias("campaign_id"),
        F.col("p_partkey").cast("string").alias("scenario_id"),
        price.alias("total_budget"),
    )
    return rc.optimize(channel_curves(spark, folder), totals)


def optimize_simulate(spark, folder):
    """Best split of 1,000 a day and its expected outcome, per campaign and channel."""
    curves = channel_curves(spark, folder)
    totals = curves.groupBy("campaign_id").agg(F.lit(1000.0).alias("total_budget"))
    return rc.optimize_and_simulate(curves, totals)


def optimized_scenario(spark, folder):
    """The best split of the default budget, rounded and evaluated as a scenario."""
    curves = user_curves(spark, folder)
    split = rc.optimize(curves, rc.default_total(curves))
    return rc.simulate(curves, rc.split_as_budgets(split)).select(
        "campaign_id", "scenario_id", "Channel", "Spend", "Revenue", "Conversions"
    )


def default_budgets(spark, folder):
    return rc.default_budgets(channel_curves(spark, folder))


def budget_grid(spark, folder):
    return rc.budget_grid(channel_curves(spark, folder))


def channel_rank(spark, folder):
    return sm.rank_channels(durable(user_channel_rows(spark, folder))).select(
        "campaign_id", "Channel", "roas", "rank", "is_best", "is_worst"
    )


def best_channel(spark, folder):
    return sm.best_channel(user_channel_rows(spark, folder))


def channel_tiers(spark, folder):
    return dx.channel_tiers(user_channel_rows(spark, folder)).select(
        "campaign_id", "Channel", "roas", "tier", "action"
    )


def channel_tiers_basic(spark, folder):
    return dx.channel_tiers(user_channel_rows(spark, folder), "basic").select(
        "campaign_id", "Channel", "roas", "tier", "action"
    )


def trend_growth(spark, folder):
    return dx.trend(flat_summary(spark, folder)).select(
        "campaign_id", "trend", "revenue_growth_pct", "spend_growth_pct", "is_healthy",
        "growth_label",
    )


def risk_flags(spark, folder):
    return dx.risk_flags(*summary_and_channels(spark, folder))


def shift_plan(spark, folder):
    return dx.shift_plan(*summary_and_channels(spark, folder))


def scenario_verdict(spark, folder):
    totals = rc.totals_of_budgets(channel_curves(spark, folder), supplier_budgets(spark, folder))
    return dx.scenario_verdict(totals, flat_summary(spark, folder))


def _told(spark, folder):
    metrics = fc.forecast_all_flat(stored_short(spark, folder))
    summary = durable(sm.forecast_summary(metrics))
    ranked = durable(sm.rank_channels(durable(sm.channel_summary(metrics))))
    return summary, ranked


def narrative(spark, folder):
    return nv.narrative(*_told(spark, folder))


def narrative_blocks(spark, folder):
    lines = nv.narrative(*_told(spark, folder))
    return nv.report_blocks(lines, ["campaign_id", "section"]).groupBy(
        "campaign_id", "section", "kind"
    ).agg(F.count("*").alias("blocks"))


def prompt_table(spark, folder):
    return nv.prompt_table(*_told(spark, folder))


def narrative_basic(spark, folder):
    return nv.narrative(*_told(spark, folder), style="basic")


def _supplier_totals(spark, folder):
    return rc.totals_of_budgets(channel_curves(spark, folder), supplier_budgets(spark, folder))


def narrative_scenarios(spark, folder):
    """The report with a section per scenario."""
    return nv.narrative(*_told(spark, folder), totals=_supplier_totals(spark, folder))


def prompt_scenarios(spark, folder):
    return nv.prompt_table(*_told(spark, folder), totals=_supplier_totals(spark, folder))


def intent_routing(spark, folder):
    return ms.route_messages(messages(spark, folder)).select("message_id", "intent")


def answer_messages(spark, folder):
    facts = ms.answer_facts(*summary_and_channels(spark, folder))
    return ms.answer_messages(messages(spark, folder), facts)


def report_blocks(spark, folder):
    """Every document with its lines turned into headings, bullets and bold text in turns."""
    marked = F.expr(
        "array_join(transform(split(text, '\n'), (x, i) -> concat("
        "case (i + doc_id) % 5 when 0 then '## ' when 1 then '  ### ' when 2 then '- **' "
        "when 3 then '* ' else '' end, replace(x, ' ', if((i + doc_id) % 3 = 0, ' ** ', ' ')))), "
        "'\n')"
    )
    documents = ad.table(spark, folder, "documents").select("doc_id", marked.alias("text"))
    return nv.report_blocks(documents, ["doc_id"])


def report_kpis(spark, folder):
    return rp.kpi_callout(flat_summary(spark, folder))


def report_channels(spark, folder):
    return rp.channel_breakdown(short_channel_rows(spark, folder))


def catalog_latest(spark, folder):
    """Orders as catalog entries: a campaign per customer, an entry per order."""
    entries = ad.table(spark, folder, "orders").select(
        F.concat(F.lit("k_"), F.col("o_custkey").cast("string")).alias("campaign_id"),
        F.col("o_orderkey").cast("string").alias("filename"),
        F.col("o_orderpriority").alias("storage_path"),
        F.col("o_totalprice").alias("total_spend"),
        F.col("o_orderdate").cast("date").alias("updated_at"),
    )
    return ct.catalog_latest(entries)


def synth_campaigns(spark, folder):
    suppliers = ad.table(spark, folder, "supplier").select(F.col("s_name").alias("campaign_id"))
    return sy.synth_campaigns(suppliers, "2024-03-31")


_QUERIES = (
    kpi_ratios, calendar_features, rolling_lag, featured_long_history, dataset_summary,
    channel_list, daily_totals, preview_rows, iso_records, clean_dates, clean_channel,
    clean_numeric, clean_numeric_strict, duplicate_count, merge_duplicates, clean_facts,
    clean_stored_profile, cleaning_audit, last_row, last30_dates, future_calendar, forecast_flat,
    forecast_forest, forecast_forest_nodes, forecast_all, forecast_skeleton, prediction_bounds, history_rows, projected_summary,
    historical_summary, forecast_summary, kpi_cards, daily_actual_vs_forecast, channel_summary,
    contribution_share, fit_curves, fit_curves_many_series, simulate, scenario_totals,
    scenario_totals_direct, scenario_rollup, unmatched_budgets, baseline, scenario_compare,
    optimize, optimize_scenarios, optimize_many_totals, optimize_simulate, optimized_scenario, default_budgets, budget_grid, channel_rank,
    best_channel, channel_tiers, channel_tiers_basic, trend_growth, risk_flags, shift_plan,
    scenario_verdict, narrative, narrative_blocks, prompt_table, intent_routing, answer_messages,
    report_blocks, report_kpis, report_channels, catalog_latest, synth_campaigns,
    forecast_forest_checks, forecast_rows_checks, daily_draws, prediction_bounds_default, prediction_bounds_other, narrative_basic,
    narrative_scenarios, prompt_scenarios, *stored.QUERIES,
)

# Allocations and scenarios carry the rounding of several steps; four decimals are cents of cents.
_FOUR_DIGITS = (
    optimize_scenarios, optimize_many_totals, optimize, optimize_simulate, optimized_scenario, simulate, scenario_totals,
    scenario_totals_direct, scenario_rollup, budget_grid, scenario_verdict,
)


def queries() -> dict[str, Query]:
    def finished(function) -> Query:
        digits = 4 if function in _FOUR_DIGITS else 6
        return lambda spark, folder: comparable(function(spark, folder), digits)

    return {function.__name__: finished(function) for function in _QUERIES}
