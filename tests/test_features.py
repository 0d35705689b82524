"""Features against a plain computation, and their independence of row order and partitions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from adlens.functions.numbers import half_up, pct_change, ratio, z_score
from adlens.operators import features as ft, summary as sm
from adlens.schema import FACT_SCHEMA

from conftest import records


def plain_windows(rows):
    """Rolling mean of spend and ROAS over seven rows and lags, by brute force."""
    series = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        series.setdefault((row[0], row[2]), []).append(row)
    out = {}
    for key, members in series.items():
        for i, row in enumerate(members):
            recent = members[max(0, i - 6):i + 1]
            roas = [r[7] / r[3] if r[3] > 0 else 0.0 for r in recent]
            out[(*key, row[1])] = (
                sum(r[3] for r in recent) / len(recent),
                sum(roas) / len(roas),
                members[i - 7][3] if i >= 7 else 0.0,
                members[i - 7][7] if i >= 7 else 0.0,
            )
    return out


NAMES = ("Spend_MA7", "ROAS_MA7", "Spend_Lag7", "Revenue_Lag7")


def random_rows(seed, stamped=False):
    rng = random.Random(seed)
    rows = []
    for campaign in ("a", "b"):
        for channel in ("x", "y", "z"):
            for day in range(30):
                if rng.random() < 0.3:
                    continue
                for _ in range(rng.choice([1, 1, 2, 5, 12]) if stamped else 1):
                    when = datetime.datetime(2025, 1, 1) + datetime.timedelta(
                        days=day, seconds=rng.randrange(86400) if stamped else 0)
                    spend = rng.choice([0.0, rng.uniform(1, 100)])
                    rows.append((campaign, when if stamped else when.date(), channel, spend,
                                 1.0, 1.0, 1.0, rng.uniform(0, 300)))
    rng.shuffle(rows)
    return rows


def test_windows(spark):
    rows = random_rows(1)
    facts = spark.createDataFrame(rows, FACT_SCHEMA)
    expected = plain_windows(rows)
    for partitions in (1, 7):
        got = records(ft.engineer_features(facts.repartition(partitions)))
        assert len(got) == len(rows)
        for r in got:
            key = (r["campaign_id"], r["Channel"], r["Date"])
            assert [r[n] for n in NAMES] == [pytest.approx(v) for v in expected[key]]


def test_windows_of_long_series_are_cut_into_days(spark):
    rows = random_rows(2, stamped=True)
    schema = "campaign_id string, Date timestamp, Channel string, Spend double, " \
             "Impressions double, Clicks double, Conversions double, Revenue double"
    facts = spark.createDataFrame(rows, schema)
    expected = plain_windows(rows)
    featured = ft.engineer_features(facts, grain="timestamp")
    got = records(featured)
    assert len(got) == len(rows)
    assert featured.columns == ft.engineer_features(facts).columns
    for r in got:
        key = (r["campaign_id"], r["Channel"], r["Date"])
        assert [r[n] for n in NAMES] == [pytest.approx(v) for v in expected[key]]


def test_ratios_are_guarded(spark):
    facts = spark.createDataFrame(
        [("a", datetime.date(2025, 12, 25), "x", 0.0, 0.0, 0.0, 0.0, 10.0)], FACT_SCHEMA)
    row = records(ft.with_kpis(facts))[0]
    assert [row[c] for c in ("CTR", "CPC", "CPA", "ROAS", "ConvRate")] == [0.0] * 5


def test_holidays(spark):
    days = [(7, 3), (7, 4), (11, 24), (11, 25), (11, 26), (11, 28), (11, 29), (12, 24), (12, 25)]
    rows = [(datetime.date(2023, m, d),) for m, d in days]
    flags = [r["HolidayFlag"] for r in records(
        ft.with_calendar(spark.createDataFrame(rows, "Date date")), "Date")]
    assert flags == [0, 1, 0, 1, 0, 0, 1, 0, 1]


def test_model_calendar(spark):
    day = datetime.date(2024, 2, 29)
    row = records(ft.with_model_features(spark.createDataFrame([(day,)], "Date date")))[0]
    assert (row["Ordinal"], row["DayOfWeek"], row["DayOfMonth"], row["Month"]) == (
        day.toordinal(), day.weekday(), 29, 2)


def test_scalars(spark):
    row = spark.range(1).select(
        *[z_score(v).alias(f"z{i}") for i, v in enumerate((0.95, 0.90, 0.99, 0.80))],
        half_up(F.lit(2.5)).alias("a"), half_up(F.lit(-2.5)).alias("b"),
        pct_change(F.lit(3.0), F.lit(0.0)).alias("c"), pct_change(F.lit(3.0), F.lit(2.0)).alias("d"),
        ratio(F.lit(1.0), F.lit(0.0)).alias("e"),
    ).first()
    assert list(row) == [1.96, 1.645, 2.576, 2.576, 3, -2, 0.0, 50.0, 0.0]


def test_rank_with_many_equal_zeros(spark):
    rng = random.Random(3)
    rows = [("a", f"ch{i}", 0.0 if i % 3 else rng.uniform(-3, 9), 1.0) for i in range(300)]
    rows += [("b", "only", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "campaign_id string, Channel string, roas double, spend double")
    ranked = sm.rank_channels(frame)
    got = [r for r in records(ranked, "campaign_id", "rank")]
    in_a = [r for r in got if r["campaign_id"] == "a"]
    assert [r["rank"] for r in in_a] == list(range(1, 301))
    assert [r["roas"] for r in in_a] == sorted((r[2] for r in rows if r[0] == "a"), reverse=True)
    assert [r["is_best"] for r in in_a].count(True) == 1 and in_a[0]["is_best"]
    assert [r["is_worst"] for r in in_a].count(True) == 1 and in_a[-1]["is_worst"]
    assert got[-1]["is_best"] and not got[-1]["is_worst"]
    from adlens.operators.diagnose import best_and_worst
    ends = records(best_and_worst(frame).where("campaign_id = 'a'"))[0]
    assert (ends["best_channel"], ends["worst_channel"]) == (in_a[0]["Channel"], in_a[-1]["Channel"])


def test_last_dates_are_dates_with_data(spark):
    rows = [("a", datetime.date(2025, 1, 1) + datetime.timedelta(days=3 * i), c, 1.0, 1.0, 1.0, 1.0,
             1.0) for i in range(50) for c in ("x", "y")]
    facts = spark.createDataFrame(rows, FACT_SCHEMA)
    dates = sorted({r["Date"] for r in records(sm.last_n_dates(facts, 30))})
    assert len(dates) == 30 and dates[0] == datetime.date(2025, 1, 1) + datetime.timedelta(days=60)
