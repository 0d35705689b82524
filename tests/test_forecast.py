"""Forest against a plain recursive tree, and the properties of forecasts."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import features as ft, forecast as fc, forecast_rows as fr, summary as sm
from adlens.operators.forest import bootstrap_counts, by_tree, forests, grow, grow_all, predict
from adlens.schema import FACT_SCHEMA, FORECAST_COLUMNS

from conftest import records


def grow_and_predict(x, y, points, counts, depth, seed):
    return predict(grow(x, y, counts, depth, seed), points, len(counts) * y.shape[1])


def plain_tree(x, y, w, points, depth):
    """Recursive regression tree without any tie between features."""
    mean = np.average(y, weights=w)
    if depth == 0 or len(set(y)) == 1:
        return np.full(len(points), mean)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            score = sum((y[s] * w[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or score > best[0]:
                best = (score, f, (a + b) / 2)
    if best is None:
        return np.full(len(points), mean)
    _, f, cut = best
    left, go_left = x[:, f] <= cut, points[:, f] <= cut
    out = np.empty(len(points))
    out[go_left] = plain_tree(x[left], y[left], w[left], points[go_left], depth - 1)
    out[~go_left] = plain_tree(x[~left], y[~left], w[~left], points[~go_left], depth - 1)
    return out


@pytest.mark.parametrize("rows, depth", [(5, 8), (40, 8), (120, 3)])
def test_trees(rows, depth):
    rng = np.random.default_rng(rows)
    x = rng.random((rows, 3))
    y = rng.random(rows) * 100 + 1e6
    counts = bootstrap_counts(rows, 12, 42)
    assert counts.sum(axis=1).tolist() == [rows] * 12
    got = grow_and_predict(x, y[:, None], x, counts, depth, 42)
    for tree in range(12):
        drawn = counts[tree] > 0
        # Cuts on different features that part the rows alike are equal, so only the drawn rows
        # have one right prediction.
        known = x[drawn]
        expected = plain_tree(known, y[drawn] - 1e6, counts[tree][drawn], known, depth)
        assert np.allclose(got[tree][drawn] - 1e6, expected, atol=1e-6)
    whole = grow_and_predict(x, y[:, None], x, np.ones((1, rows)), 60, 42)
    assert np.allclose(whole[0], y)


def test_single_feature_trees_are_exact():
    rng = np.random.default_rng(5)
    x, y = np.arange(60.0)[:, None], rng.random(60)
    counts = bootstrap_counts(60, 20, 1)
    got = grow_and_predict(x, y[:, None], x, counts, 8, 1)
    for tree in range(20):
        drawn = counts[tree] > 0
        expected = plain_tree(x[drawn], y[drawn], counts[tree][drawn], x, 8)
        assert np.allclose(got[tree], expected)


def test_forests_together_and_apart():
    rng = np.random.default_rng(9)
    for rows in (50, 790, 810):
        days = np.arange(rows) + 738_000
        x = np.stack([days, days % 7, days % 31, days // 31 % 12, days % 97 == 0], axis=1).astype(float)
        y = rng.random((rows, 5)) * [1, 10, 100, 1000, 1e6]
        together = forests(x, y, x[-30:], 5, 8, 42)
        apart = forests(x, y, x[-30:], 5, 8, 42, at_once=0)
        assert len(together) == 5 and all((a == b).all() for a, b in zip(together, apart))


def facts(spark, seed=7):
    rng = random.Random(seed)
    rows = []
    for channel, days in (("long", 40), ("five", 5), ("four", 4), ("one", 1)):
        for d in range(days):
            rows.append(("a", datetime.date(2025, 6, 1) + datetime.timedelta(days=d), channel,
                         *[rng.uniform(1, 100) for _ in range(5)]))
    return ft.engineer_features(spark.createDataFrame(rows, FACT_SCHEMA))


def test_forecast_properties(spark):
    featured = facts(spark)
    table = fc.forecast(featured, 30)
    assert table.columns == ["campaign_id", *FORECAST_COLUMNS]
    rows = records(table)
    ahead = [r for r in rows if r["IsForecast"]]
    assert len(ahead) == 4 * 30 and len(rows) == 4 * 30 + 50
    spans = {r["Channel"]: r for r in records(featured.groupBy("Channel").agg(
        F.max("Date").alias("end"), F.min("Revenue").alias("low"), F.max("Revenue").alias("high")))}
    for channel, span in spans.items():
        mine = sorted((r for r in ahead if r["Channel"] == channel), key=lambda r: r["Date"])
        assert mine[0]["Date"] == span["end"] + datetime.timedelta(days=1)
        assert mine[-1]["Date"] == span["end"] + datetime.timedelta(days=30)
        for r in mine:
            assert 0 <= r["Revenue_Lower"] <= r["Revenue"] <= r["Revenue_Upper"]
            assert 0 <= r["Conversions_Lower"] <= r["Conversions"] <= r["Conversions_Upper"]
            assert span["low"] - 1e-9 <= r["Revenue"] <= span["high"] + 1e-9
            assert r["ROAS"] == pytest.approx(r["Revenue"] / r["Spend"])
    flat = [r for r in ahead if r["Channel"] == "four"]
    last = [r for r in rows if r["Channel"] == "four" and not r["IsForecast"]]
    last = max(last, key=lambda r: r["Date"])
    for r in flat:
        assert r["Revenue"] == last["Revenue"] and r["ROAS"] == last["ROAS"]
        assert r["Revenue_Lower"] == pytest.approx(last["Revenue"] * 0.9)
        assert r["Conversions_Upper"] == pytest.approx(last["Conversions"] * 1.1)


def test_forest_does_not_depend_on_partitions(spark):
    featured = facts(spark)
    first = records(fc.forecast_forest(featured.repartition(1), 7), "Channel", "Date")
    second = records(fc.forecast_forest(featured.repartition(9), 7), "Channel", "Date")
    assert len(first) == 14 and first == second


def test_wider_level_wider_band(spark):
    trees = fc.forest_trees(facts(spark), 5).cache()
    stats = fc.tree_stats(trees)
    direct = records(fc.forest_stats(facts(spark), 5), "Channel", "Date")
    for ours, theirs in zip(records(stats, "Channel", "Date"), direct, strict=True):
        assert all(v == (pytest.approx(theirs[n]) if isinstance(v, float) else theirs[n])
                   for n, v in ours.items())
    width = {}
    for level in (0.90, 0.95, 0.99, 0.80):
        rows = records(fc.prediction_bounds(stats, level), "Channel", "Date")
        width[level] = sum(r["Revenue_Upper"] - r["Revenue"] for r in rows)
    assert width[0.90] < width[0.95] < width[0.99] == width[0.80]
    row = trees.first()
    assert len(row["Spend_trees"]) == 50
    bounded = records(fc.prediction_bounds(stats, 0.95).where(
        (F.col("Channel") == row["Channel"]) & (F.col("Date") == row["Date"])))[0]
    values = np.array(row["Revenue_trees"])
    assert bounded["Revenue"] == pytest.approx(values.mean())
    assert bounded["Revenue_Upper"] == pytest.approx(values.mean() + 1.96 * values.std())
    trees.unpersist()


def test_horizon_is_checked(spark):
    for wrong in (0, -1, None, 1.5, True):
        with pytest.raises(ValueError):
            fc.forecast_flat(facts(spark), wrong)
        with pytest.raises(ValueError):
            fc.forest_trees(facts(spark), wrong)
        with pytest.raises(ValueError):
            fc.future_calendar(facts(spark), wrong)


def test_overlap_dates_show_actuals(spark):
    chart = records(sm.daily_actual_vs_forecast(fc.forecast_all_flat(facts(spark), 30)), "Date")
    by_date = {r["Date"]: r for r in chart}
    overlap = by_date[datetime.date(2025, 6, 20)]
    assert not overlap["is_forecast"] and overlap["spend_forecast"] is None
    assert overlap["revenue_lower"] == overlap["revenue_actual"]
    late = by_date[datetime.date(2025, 7, 25)]
    assert late["is_forecast"] and late["spend_actual"] is None


def test_several_rows_per_day_are_refused(spark):
    rows = [("a", datetime.date(2025, 6, 1 + i % 6), "x", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(12)]
    featured = ft.engineer_features(spark.createDataFrame(rows, FACT_SCHEMA))
    with pytest.raises(Exception, match="several rows per day"):
        fc.forecast_forest(featured, 5).collect()
    merged = ft.engineer_features(sm.daily(featured))
    assert fc.forecast_forest(merged, 5).count() == 5


def test_stored_nodes_predict_like_the_forests(spark):
    featured = facts(spark)
    nodes = fc.forest_nodes(featured, n_trees=6).cache()
    assert nodes.count() == 2 * 5 * 6  # channels with enough rows, targets, trees
    scored = fc.score_nodes(nodes, fc.future_calendar(featured, 9))
    direct = records(fc.forest_stats(featured, 9, n_trees=6), "Channel", "Date")
    for ours, theirs in zip(records(scored, "Channel", "Date"), direct, strict=True):
        assert all(v == (pytest.approx(theirs[n]) if isinstance(v, float) else theirs[n]) for n, v in ours.items())
    known = fc.score_nodes(nodes, featured)  # any days, also those of the history
    assert known.count() == 45
    nodes.unpersist()


def test_node_tables_of_one_and_of_all_targets_agree():
    rng = np.random.default_rng(3)
    x = np.stack([np.arange(80), np.arange(80) % 7], axis=1).astype(float)
    y = rng.random((80, 3)) * [1, 50, 1e6]
    together, apart = grow_all(x, y, 4, 8, 42), grow_all(x, y, 4, 8, 42, at_once=0)
    assert len(together) == 1 and len(apart) == 3
    sorted_nodes, starts = by_tree(together[0])
    assert len(starts) == 12 and (sorted_nodes.path[starts] == 1).all()
    sizes = np.diff(np.append(starts, len(sorted_nodes.tree)))
    inner = sorted_nodes.feature >= 0
    assert (sorted_nodes.left[inner] + 1 < np.repeat(sizes, sizes)[inner]).all()
    assert (sorted_nodes.left[~inner] == -1).all()
    assert (predict(together[0], x, 12) == np.concatenate([predict(n, x, 4) for n in apart])).all()


def test_draws_look_random():
    counts = bootstrap_counts(200, 300, 42)
    assert abs((counts == 0).mean() - np.exp(-1)) < 0.01 and abs(counts.var() - 1) < 0.05
    assert abs(np.corrcoef(counts[:, :100].T)[np.triu_indices(100, 1)].mean()) < 0.02


def _stamped(spark, days=40, seed=5):
    """Two channels with no, some or many rows a day, and one with four rows in all."""
    draw = random.Random(seed)
    rows = []
    for channel, most in (("A", 6), ("B", 90), ("C", 0)):
        for day in range(days):
            start = datetime.datetime(2025, 10, 20) + datetime.timedelta(days=day)
            for i in range(draw.randint(0, most) if most else int(day < 4)):
                spend = round(draw.uniform(0, 50) + 20 * (day % 7), 2)
                rows.append(("k", start + datetime.timedelta(seconds=977 * i), channel, spend, 100.0, float(draw.randint(0, 9)),
                             float(draw.randint(0, 3)), round(spend * draw.uniform(0, 3), 2)))
    schema = "campaign_id string, Date timestamp, Channel string, Spend double, Impressions double, Clicks double, Conversions double, Revenue double"
    return spark.createDataFrame(rows, schema)


def test_rows_grow_the_trees_of_all_drawn_rows(spark):
    rows, trees, seed = _stamped(spark), 12, 7
    got = {(r.Channel, r.Date): r for r in fr.forest_stats_of_rows(rows, 9, n_trees=trees, seed=seed).collect()}
    assert {c for c, _ in got} == {"A", "B"} and len(got) == 18
    drawn = fr.row_draws(rows, n_trees=trees, seed=seed).where("_tree >= 0").collect()
    holidays = frozenset(divmod(d, 100) for d in fc.HOLIDAYS)
    for channel in "AB":
        known = sorted(r for r in rows.collect() if r.Channel == channel)
        counts = np.zeros((trees, len(known)))
        place = {r.Date: i for i, r in enumerate(known)}
        for r in drawn:
            if r.Channel == channel:
                counts[r._tree, place[r.Date]] = r._draws
        assert 0.9 < counts.mean() < 1.1 and abs((counts == 0).mean() - np.exp(-1)) < 0.05
        features = np.array([[d.toordinal(), d.weekday(), d.day, d.month, int((d.month, d.day) in holidays)]
                             for d in (r.Date.date() for r in known)])
        dates, future = fc.forest.future_points(int(features[-1, 0]), 9, holidays)
        for target in ("Spend", "Clicks", "Revenue"):
            values = np.array([[r[target]] for r in known])
            whole = predict(grow(features, values, counts, 8, seed), future, trees)
            for i, date in enumerate(dates):
                assert got[channel, date][f"{target}_mean"] == pytest.approx(whole[:, i].mean(), rel=1e-6, abs=1e-6)
                assert got[channel, date][f"{target}_std"] == pytest.approx(whole[:, i].std(), rel=1e-5, abs=1e-5)


def test_rows_whole_forecast(spark):
    rows = ft.engineer_features(_stamped(spark), grain="timestamp")
    made = fr.forecast_rows(rows, 5, n_trees=6)
    again = fr.forecast_rows(rows.repartition(7), 5, n_trees=6)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    counts = {(r[0], r[1]): r[2] for r in made.groupBy("Channel", "IsForecast").count().collect()}
    assert all(counts[c, True] == 5 for c in "ABC") and counts["C", False] == 4
    assert counts["B", False] == rows.where("Channel = 'B'").count()
    assert made.columns == ["campaign_id", *FORECAST_COLUMNS]
    assert fr.forecast_rows(rows.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        fr.forest_stats_of_rows(rows, 0)


def test_a_tree_without_draws_takes_all_rows(spark):
    few = _stamped(spark).where("Channel = 'C'")
    got = fr.forest_stats_of_rows(few, 2, n_trees=400, min_rows=4).collect()
    assert len(got) == 2 and all(np.isfinite(r.Spend_mean) for r in got)


def _random_series(rows, days, seed):
    """Features and targets of ``rows`` of the days from November on, some with gaps and ties."""
    draw = np.random.default_rng(seed)
    dates = [datetime.date(2023, 11, 20) + datetime.timedelta(days=int(i)) for i in sorted(draw.choice(days, rows, replace=False))]
    known = [[d.toordinal(), d.weekday(), d.day, d.month, int((d.month, d.day) == (12, 25))] for d in dates]
    return np.array(known, float), np.stack([draw.random(rows).round(2), draw.integers(0, 3, rows), np.full(rows, 7.0)], axis=1)


@pytest.mark.parametrize("days, depth", [(8, 8), (90, 8), (400, 12)])
def test_series_grown_together_keep_their_trees(days, depth):
    series = [_random_series(n, days, n) for n in (5, 1, 8, 8, 7)] + [_random_series(min(days, 60), days, 9)]
    series[1][1][0, 0], series[2][1][3, 1] = np.nan, np.inf  # a spoiled target spoils no other series
    with np.errstate(all="ignore"):
        together, _ = by_tree(fc.forest.grow_many(series, fc.forest.Draws(12, depth, 42)))
        alone = [by_tree(grow_all(x, y, 12, depth, 42)[0])[0] for x, y in series]
    for name in ("path", "feature", "threshold", "left", "value"):
        expected = np.concatenate([getattr(nodes, name) for nodes in alone])
        assert np.array_equal(getattr(together, name), expected, equal_nan=expected.dtype.kind == "f")


def test_forests_take_many_series_per_call(spark):
    featured = facts(spark)
    expected = sorted(map(str, fc.forest_stats(featured, 9, n_trees=6).collect()))
    plan = fc.forest_stats(featured, 9)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # series lie across batches
    try:
        assert sorted(map(str, fc.forest_stats(featured, 9, n_trees=6).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_node_walk_is_compiled_and_sorts_no_nodes(spark):
    featured = facts(spark)
    scored = fc.score_nodes(fc.forest_nodes(featured, n_trees=2), fc.future_calendar(featured, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "lambda" not in plan and "SortMergeJoin" not in plan
