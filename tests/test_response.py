"""Allocation against a bisection, and the rules of scenarios."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adlens.operators import response as rc
from adlens.operators.spread import attach, cut_evenly, running_totals, tie_hash, value_bucket

from conftest import records

CURVES = ("campaign_id string, Channel string, alpha_rev double, alpha_conv double, "
          "alpha_clicks double, alpha_imp double, avg_spend double, avg_revenue double, "
          "avg_conversions double")


def curves_of(spark, alphas):
    return spark.createDataFrame(
        [(c, f"ch{i:04d}", float(a), a / 100.0, a / 10.0, float(a), 50.0 + i, 100.0 + i, 3.0)
         for c, values in alphas.items() for i, a in enumerate(values)], CURVES)


def bisection(alphas, budget):
    """Same optimum found by halving the interval of the multiplier."""
    if budget <= 0:
        return [0.0] * len(alphas)
    if sum(alphas) == 0:
        return [budget / len(alphas)] * len(alphas)
    low, high = 1e-300, max(alphas) + 1.0
    for _ in range(3000):
        mid = math.sqrt(low * high)
        if sum(max(0.0, a / mid - 1.0) for a in alphas) > budget:
            low = mid
        else:
            high = mid
    shares = [max(0.0, a / high - 1.0) for a in alphas]
    return [s / sum(shares) * budget for s in shares]


def test_allocation_against_bisection(spark):
    rng = random.Random(11)
    alphas, budgets = {}, {}
    for i in range(60):
        size = rng.randrange(1, 40)
        alphas[f"c{i}"] = [0.0 if rng.random() < 0.2 else 10 ** rng.uniform(-2, 5)
                           for _ in range(size)]
        budgets[f"c{i}"] = 10 ** rng.uniform(-1, 6)
    alphas["wide"] = [0.0 if i % 3 == 0 else rng.expovariate(0.01) for i in range(3000)]
    budgets["wide"] = 2000.0
    alphas.update(zeros=[0.0] * 4, one=[5.0], equal=[7.0] * 9, none=[3.0, 4.0], tiny=[9.0, 9.0, 1.0],
                  huge=[121.0, 105.0, 3.0], edge=[121.0, 105.0, 3.0])
    budgets.update(zeros=100.0, one=10.0, equal=90.0, none=0.0, tiny=1e-12, huge=1e12, edge=1.0)
    totals = spark.createDataFrame(list(budgets.items()), "campaign_id string, total_budget double")
    curves = curves_of(spark, alphas)
    got = {}
    for r in records(rc.optimize(curves, totals), "campaign_id", "Channel"):
        got.setdefault(r["campaign_id"], []).append(r["budget"])
    assert set(got) == set(alphas)
    for name, values in alphas.items():
        budget = budgets[name]
        expected = bisection(values, budget)
        assert sum(got[name]) == pytest.approx(budget, rel=1e-9)
        assert min(got[name]) >= 0
        assert got[name] == [pytest.approx(e, rel=1e-6, abs=1e-7 * max(budget, 1e-9))
                             for e in expected]
        if budget > 0 and sum(values) > 0:
            margins = [a / (1 + x) for a, x in zip(values, got[name])]
            active = [m for m, x in zip(margins, got[name]) if x > 1e-9 * budget]
            assert max(margins) <= max(active) * (1 + 1e-6)
    assert got["edge"][2] == 0.0


def test_budgets_only_for_some_campaigns(spark):
    curves = curves_of(spark, {"a": [1.0, 2.0], "b": [3.0]})
    totals = spark.createDataFrame([("a", 10.0), ("zzz", 5.0)], "campaign_id string, total_budget double")
    rows = records(rc.optimize(curves, totals), "Channel")
    assert {r["campaign_id"] for r in rows} == {"a"} and len(rows) == 2


BUDGETS = "campaign_id string, scenario_id string, Channel string, budget double"


def test_scenarios(spark):
    curves = curves_of(spark, {"a": [100.0, 50.0, 0.0]})
    budgets = spark.createDataFrame(
        [("a", "s", "ch0000", 0.0), ("a", "s", "nobody", 7.0), ("a", "t", "nobody", 7.0)], BUDGETS)
    rows = {(r["scenario_id"], r["Channel"]): r for r in records(rc.simulate(curves, budgets))}
    assert len(rows) == 6
    assert rows[("s", "ch0000")]["Spend"] == 0 and rows[("s", "ch0000")]["ROAS"] == 0.0
    assert rows[("s", "ch0001")]["Spend"] == 51.0
    assert rows[("t", "ch0000")]["Spend"] == 50.0
    assert rows[("s", "ch0001")]["Revenue"] == pytest.approx(50.0 * math.log(52.0))
    assert rows[("s", "ch0002")]["CPA"] == 0.0 and rows[("s", "ch0002")]["CTR"] == 0.0
    lost = records(rc.unmatched_budgets(curves, budgets))
    assert sorted(r["scenario_id"] for r in lost) == ["s", "t"]


def test_totals_of_budgets_are_those_of_the_simulation(spark):
    rng = random.Random(8)
    curves = curves_of(spark, {c: [rng.uniform(0, 500) for _ in range(30)] for c in ("a", "b")})
    rows = [(c, f"s{s}", f"ch{i:04d}", rng.uniform(0, 900)) for c in ("a", "b") for s in range(9)
            for i in rng.sample(range(33), rng.randrange(1, 33))]
    budgets = spark.createDataFrame([*rows, ("a", "lost", "nobody", 5.0), ("c", "s", "x", 1.0)], BUDGETS)
    direct = records(rc.totals_of_budgets(curves, budgets), "campaign_id", "scenario_id")
    summed = records(rc.scenario_totals(rc.simulate(curves, budgets)), "campaign_id", "scenario_id")
    assert len(direct) == 19
    for ours, theirs in zip(direct, summed, strict=True):
        assert all(v == (pytest.approx(theirs[n], rel=1e-9) if isinstance(v, float) else theirs[n])
                   for n, v in ours.items())


def test_usual_scenario(spark):
    curves = curves_of(spark, {"a": [100.0, 50.0], "b": [3.0]})
    usual = rc.usual_scenario(curves)
    rows = records(rc.simulate(curves, usual), "campaign_id", "Channel")
    assert [r["Spend"] for r in rows] == [50.0, 51.0, 50.0]
    totals = records(rc.totals_of_budgets(curves, usual), "campaign_id")
    assert [t["TotalSpend"] for t in totals] == [101.0, 50.0]
    assert totals[0]["TotalRevenue"] == pytest.approx(100 * math.log(51) + 50 * math.log(52))


def test_negative_budgets_are_refused(spark):
    curves = curves_of(spark, {"a": [100.0]})
    budgets = spark.createDataFrame([("a", "s", "ch0000", -1.0)], BUDGETS)
    with pytest.raises(Exception, match="budget below 0"):
        rc.simulate(curves, budgets).collect()


def test_grid(spark):
    curves = curves_of(spark, {"a": [10.0]}).withColumn("avg_spend", F.lit(0.0))
    wide = curves.withColumn("avg_spend", F.lit(7000.4)).withColumn("campaign_id", F.lit("w"))
    rows = records(rc.budget_grid(curves.unionByName(wide)), "campaign_id", "budget")
    assert [r["budget"] for r in rows if r["campaign_id"] == "a"] == list(range(0, 5001, 10))
    assert [r["budget"] for r in rows if r["campaign_id"] == "w"] == list(range(0, 21001, 10))
    assert rows[10]["Revenue"] == pytest.approx(10 * math.log(101))


def test_running_totals_on_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", f"n{i}", round(rng.expovariate(0.1), 3)) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, n string, v double")
    out = records(running_totals(frame, ["k"], {"b": value_bucket(F.col("v"))},
                                 [F.desc("v"), F.col("n")], "pos", {"s": F.col("v")}))
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        got = sorted((r for r in out if r["k"] == key), key=lambda r: r["pos"])
        assert [r["n"] for r in got] == [r[1] for r in ordered]
        total = 0.0
        for i, (r, o) in enumerate(zip(got, ordered)):
            total += o[2]
            assert r["pos"] == i + 1 and r["s"] == pytest.approx(total)


@pytest.mark.parametrize("value", ["2.0 + rand(7) * 0.2", "2.1", "if(id % 2 = 0, 0, rand(7))",
                                   "if(id % 3 = 0, -1e9, pow(10, rand(7) * 20))"])
def test_cuts_are_even_whatever_the_values(spark, value):
    n = 100_000
    rows = spark.range(0, n, 1, 4).select(
        F.lit("k").alias("k"), F.concat(F.lit("n"), "id").alias("n"), F.expr(f"double({value})").alias("v"))
    cut = cut_evenly(rows, ["k"], "v", "n")
    assert cut.groupBy("_bucket", "_tie").count().agg(F.max("count")).first()[0] <= 4 * n / 256
    placed = running_totals(cut, ["k"], {c: F.col(c) for c in ("_bucket", "_tie")},
                            [F.desc("v"), tie_hash("n"), F.col("n")], "pos", {})
    whole = Window.partitionBy("k").orderBy(F.desc("v"), F.md5("n"), "n")
    expected = rows.select("n", F.row_number().over(whole).alias("expected"))
    assert placed.join(expected, "n").where("pos <> expected").count() == 0
    assert placed.count() == n


def hot_rows(spark):
    hot = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(0, 200_000, 1, 8).select(
        hot.alias("k"), F.col("id").alias("n"), F.md5(F.col("id").cast("string")).alias("text"))


@pytest.mark.parametrize(
    "conf, seen",
    [
        ({}, "BroadcastHashJoin"),
        ({"spark.sql.autoBroadcastJoinThreshold": "-1"}, "SortMergeJoin(skew=true)"),
        ({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"},
         "SortMergeJoin ["),
    ])
def test_attach_splits_a_hot_key(spark, conf, seen):
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.shuffle.partitions": "20"}
    old = {name: spark.conf.get(name, None) for name in {**small, **conf}}
    for name, value in {**small, **conf}.items():
        spark.conf.set(name, value)
    try:
        rows = hot_rows(spark)
        sizes = rows.groupBy("k").agg(F.count("*").alias("size"))
        found = attach(rows, sizes, ["k"], by=["n"]).groupBy("k", "size").agg(
            F.count("*").alias("rows"), F.max("text"))
        got = records(found)
        assert len(got) == 51 and all(r["rows"] == r["size"] for r in got)
        assert seen in found._jdf.queryExecution().executedPlan().toString()
        if "spark.sql.adaptive.enabled" in conf:
            parts = attach(rows, sizes, ["k"], by=["n"])
            hot = parts.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
            assert len(hot) > 8 and max(r["count"] for r in hot) < 40_000
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_second_budgets_and_totals(spark):
    curves = spark.createDataFrame(
        [("c", "A", 100.0, 1.0, 1.0, 1.0, 50.0, 1.0, 1.0), ("c", "B", 60.0, 1.0, 1.0, 1.0, 50.0, 1.0, 1.0)],
        "campaign_id string, Channel string, alpha_rev double, alpha_conv double, alpha_clicks double, "
        "alpha_imp double, avg_spend double, avg_revenue double, avg_conversions double")
    twice = spark.createDataFrame([("c", "s1", "A", 200.0), ("c", "s1", "A", 300.0)],
                                  "campaign_id string, scenario_id string, Channel string, budget double")
    for answer in (rc.simulate, rc.totals_of_budgets):
        with pytest.raises(Exception, match="more than one budget"):
            answer(curves, twice).collect()
    totals = spark.createDataFrame([("c", 100.0), ("c", 500.0)], "campaign_id string, total_budget double")
    with pytest.raises(Exception, match="more than one total"):
        rc.optimize(curves, totals).collect()
    named = spark.createDataFrame([("c", "low", 100.0), ("c", "high", 500.0)],
                                  "campaign_id string, scenario_id string, total_budget double")
    sums = rc.optimize(curves, named).groupBy("scenario_id").agg({"budget": "sum"}).collect()
    assert {r[0]: round(r[1], 6) for r in sums} == {"low": 100.0, "high": 500.0}
    assert rc.optimize_and_simulate(curves, named).count() == 4
