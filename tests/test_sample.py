"""Known figures of the twenty-row sample."""

import pytest
from pyspark.sql import functions as F

from adlens.operators import diagnose as dx, features as ft, forecast as fc
from adlens.operators import response as rc, summary as sm
from adlens.plans import pipelines as pl

from conftest import records


def near(value, rel=1e-6):
    return pytest.approx(value, rel=rel)


def test_totals(sample):
    total = records(sm.dataset_summary(sample))[0]
    assert total["total_spend"] == 3590 and total["total_revenue"] == 11810
    assert total["total_conversions"] == near(113.25)
    assert total["overall_roas"] == near(3.289693593)
    assert total["channels_count"] == 2


def test_channel_figures(sample):
    history = fc.history_as_forecast(ft.with_kpis(sample))
    google, meta = records(sm.channel_summary(history), "Channel")
    assert (google["roas"], meta["roas"]) == (near(4.045602606), near(2.725060827))
    assert (google["cpa"], meta["cpa"]) == (near(31.072874494), near(32.184808144))
    assert (google["cpc"], meta["cpc"]) == (near(1.242914980), near(1.126027397))
    tiers = records(dx.channel_tiers(sm.channel_summary(history)), "Channel")
    assert [t["tier"] for t in tiers] == ["Highly Efficient", "Efficient"]
    basic = records(dx.channel_tiers(sm.channel_summary(history), "basic"), "Channel")
    assert [t["tier"] for t in basic] == ["Highly Efficient", "Highly Efficient"]


def test_features(sample):
    rows = {(str(r["Date"]), r["Channel"]): r for r in records(ft.engineer_features(sample))}
    names = ("Spend_MA7", "ROAS_MA7", "Spend_Lag7", "Revenue_Lag7")
    expected = {
        ("2026-06-10", "Google Ads"): (155.0, 4.015656022, 140, 590),
        ("2026-06-10", "Meta Ads"): (207.142857143, 2.708094873, 195, 530),
        ("2026-06-08", "Google Ads"): (150.0, 4.029732107, 150, 600),
        ("2026-06-08", "Meta Ads"): (200.714285714, 2.697311660, 200, 550),
    }
    for key, values in expected.items():
        assert [rows[key][n] for n in names] == [near(v) for v in values]
    assert rows[("2026-06-07", "Google Ads")]["Spend_Lag7"] == 0.0
    assert rows[("2026-06-01", "Meta Ads")]["Quarter"] == 2


def test_curves(sample):
    google, meta = records(rc.fit_curves(sample), "Channel")
    assert google["alpha_rev"] == near(123.553456084) and meta["alpha_rev"] == near(105.416635865)
    assert google["alpha_conv"] == near(0.982979246) and meta["alpha_conv"] == near(1.201945948)
    assert google["alpha_clicks"] == near(24.574481152)
    assert meta["alpha_imp"] == near(959.575971955)
    assert (google["avg_spend"], meta["avg_spend"]) == (153.5, 205.5)


def test_scenario(spark, sample):
    budgets = spark.createDataFrame(
        [("sample", "s", "Google Ads", 200.0), ("sample", "s", "Meta Ads", 300.0)],
        "campaign_id string, scenario_id string, Channel string, budget double",
    )
    result = pl.run_simulation(sample, budgets)
    google, meta = records(result.channels, "Channel")
    assert google["Revenue"] == near(655.241650056) and google["Conversions"] == near(5.213038660)
    assert meta["Revenue"] == near(601.624364620) and meta["Conversions"] == near(6.859638060)
    total = records(result.totals)[0]
    assert total["TotalSpend"] == 500 and total["TotalRevenue"] == near(1256.866014676)
    assert total["TotalConversions"] == near(12.072676720)
    assert total["TotalROAS"] == near(2.513732029)
    base = {r["Channel"]: r for r in records(result.baseline)}
    assert base["Total"]["Spend"] == 359.0 and base["Total"]["ROAS"] == near(1181.0 / 359.0)


@pytest.mark.parametrize(
    "budget, split, revenue",
    [
        (500.0, (269.881818783, 230.118181217), 1265.882533268),
        (1.0, (0.618815650, 0.381184350), 93.558448823),
    ],
)
def test_allocation(sample, budget, split, revenue):
    totals = sample.select("campaign_id").distinct().withColumn("total_budget", F.lit(budget))
    google, meta = records(pl.run_optimization(sample, totals), "Channel")
    assert (google["Spend"], meta["Spend"]) == (near(split[0], 1e-8), near(split[1], 1e-8))
    assert google["Revenue"] + meta["Revenue"] == near(revenue, 1e-8)


def test_forecast_flow(sample):
    result = pl.run_forecast(pl.features.engineer_features(sample), 30)
    assert result.metrics.where("IsForecast").count() == 60
    summary = records(result.summary)[0]
    assert summary["historical_spend"] == 3590 and summary["historical_revenue"] == 11810
    assert 0 < summary["projected_spend"]
    story = pl.run_insights(result.metrics)
    texts = [r["text"] for r in records(story.lines, "section", "line")]
    assert texts[0] == "## Forecast against history" and texts[7] == "### Google Ads"
    assert records(story.kpi_callout)[0]["historical_revenue"] == "$11,810.00"
    assert records(story.channel_breakdown, "Channel")[0]["conversions"] == "49.4"
