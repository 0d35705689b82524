"""Whole workflows: ingest, forecast, budget, insights."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from adlens.operators import cleaning, features, forecast as fc, response, summary as sm
from adlens.operators.forecast_rows import forecast_rows
from adlens.operators.narrative import narrative
from adlens.operators.reports import report_tables
from adlens.schema import CONFIDENCE, DATE_FORMATS, HORIZON_DAYS, KEYS
from adlens.session import durable
from adlens.sources.catalog import catalog_entries, catalog_upsert
from adlens.sources.files import read_campaign_csv, read_campaign_layouts, write_dataset


def prepare(
    raw: DataFrame,
    keys: Sequence[str] = KEYS,
    formats: Sequence[str] = DATE_FORMATS,
    grain: str = "day",
    mode: str = "compat",
    campaigns: int | None = None,
) -> DataFrame:
    """Raw text rows to featured facts; ``campaigns`` bounds their number if it is known."""
    facts = cleaning.clean(raw, keys, formats, grain, mode, campaigns=campaigns)
    return features.engineer_features(facts, keys, grain)


def ingest(
    spark: SparkSession,
    path: str | Sequence[str],
    store: str,
    catalog: str,
    formats: Sequence[str] = DATE_FORMATS,
    grain: str = "day",
    mode: str = "compat",
    multi_line: bool = False,
    mixed_headers: bool = False,
    id_from: str = "name",
) -> DataFrame:
    """Read, clean, feature and store campaign files and enter them in the catalog; returns the
    audit of the cleaning.

    The files are read once: facts, audit and catalog entries come from a stored profile. Each
    campaign has the date format of ``formats`` that reads most of its rows. Two files with one
    campaign id are refused before anything is stored; ``id_from="path"`` tells files of equal names
    apart. A campaign stored before is replaced. ``multi_line`` allows line breaks inside quotes,
    one task per file; without it they fail the query. ``mixed_headers`` takes files whose columns
    differ.
    """
    read = read_campaign_layouts if mixed_headers else read_campaign_csv
    raw = read(spark, path, multi_line, id_from)
    profiled = durable(cleaning.profile(raw, KEYS, formats, grain, mode))
    files = cleaning.files_of_profile(profiled)
    shared = [row[0] for row in files.where("several").select("campaign_id").limit(5).collect()]
    if shared:
        raise ValueError(f"Several files for one campaign, such as: {', '.join(shared)}")
    facts = cleaning.facts_of_profile(profiled, KEYS, mode)
    write_dataset(features.engineer_features(facts, KEYS, grain), store)
    catalog_upsert(catalog_entries(facts, store, files), catalog)
    audit = cleaning.audit_of_profile(profiled, KEYS, mode, cleaning.renamed_from(raw))
    return audit.unionByName(cleaning.date_audit_of_profile(profiled))


def keep(df: DataFrame) -> DataFrame:
    """Hold a dataset across several requests; ``unpersist`` it afterwards."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class ForecastResult(NamedTuple):
    metrics: DataFrame
    summary: DataFrame


def run_forecast(
    featured: DataFrame, horizon: int = HORIZON_DAYS, level: float = CONFIDENCE,
    keys: Sequence[str] = KEYS, grain: str = "day",
) -> ForecastResult:
    """Forecast table and its summary; the forests are grown once.

    ``grain="timestamp"`` takes several rows per channel and day.
    """
    if grain not in ("day", "timestamp"):
        raise ValueError("grain is 'day' or 'timestamp'")
    make = fc.forecast if grain == "day" else forecast_rows
    metrics = durable(make(featured, horizon, level, keys))
    return ForecastResult(metrics, sm.forecast_summary(metrics, keys=keys))


class Simulation(NamedTuple):
    channels: DataFrame
    totals: DataFrame
    baseline: DataFrame


def run_simulation(
    facts: DataFrame, budgets: DataFrame, keys: Sequence[str] = KEYS, merged: bool = True
) -> Simulation:
    """Scenario outcome, scenario totals and the baseline from one fit of the curves."""
    curves = durable(response.fit_curves(facts, keys, merged))
    return Simulation(
        response.simulate(curves, budgets, keys),
        response.totals_of_budgets(curves, budgets, keys),
        response.baseline(curves, keys),
    )


def run_optimization(
    facts: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS, merged: bool = True
) -> DataFrame:
    """Best split of each campaign's budget with its expected outcome."""
    curves = durable(response.fit_curves(facts, keys, merged))
    return response.optimize_and_simulate(curves, totals, keys)


class Insights(NamedTuple):
    lines: DataFrame
    kpi_callout: DataFrame
    channel_breakdown: DataFrame


def run_insights(
    metrics: DataFrame, totals: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> Insights:
    """Narrative lines and report tables of all campaigns from a forecast table."""
    summary = durable(sm.forecast_summary(metrics, keys=keys))
    channel_rows = durable(sm.channel_summary(metrics, keys))
    ranked = durable(sm.rank_channels(channel_rows, keys))
    return Insights(
        narrative(summary, ranked, totals, keys), *report_tables(summary, channel_rows, keys)
    )
