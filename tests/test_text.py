"""Diagnostics, narrative, messages and report blocks on small inputs."""

import os

import pytest

from adlens.operators import diagnose as dx, messages as ms, narrative as nv, summary as sm
from adlens.streaming.messages import start_answers

from conftest import records

SUMMARY = ("campaign_id string, historical_spend double, historical_revenue double, "
           "historical_conversions double, historical_roas double, projected_spend double, "
           "projected_revenue double, projected_conversions double, projected_roas double")
ROWS = ("campaign_id string, Channel string, spend double, revenue double, impressions double, "
        "clicks double, conversions double, roas double, conv_rate double, cpa double, cpc double")


def summary_of(spark, *cases):
    return spark.createDataFrame(
        [(name, 1000.0, 1000.0 * old, 10.0, old, 1000.0, 1000.0 * new, 10.0, new)
         for name, old, new in cases], SUMMARY)


def channel_rows(spark, *rows):
    return spark.createDataFrame(
        [(c, n, s, s * r, 1.0, 1.0, 1.0, r, 0.1, 12.345, 1.5) for c, n, s, r in rows], ROWS)


def test_trend(spark):
    cases = summary_of(spark, ("up", 2.0, 2.01), ("same", 2.0, 2.0), ("near", 2.0, 1.95),
                       ("down", 2.0, 1.0), ("new", 0.0, 1.6))
    got = {r["campaign_id"]: r for r in records(dx.trend(cases))}
    assert [got[c]["trend"] for c in ("up", "same", "near", "down", "new")] == [
        "improving", "stable", "stable", "declining", "improving"]
    assert got["new"]["revenue_growth_pct"] == 0.0 and got["new"]["is_healthy"]
    assert got["down"]["revenue_growth_pct"] == -50.0 and not got["down"]["is_healthy"]


def test_tier_edges(spark):
    rows = channel_rows(spark, *[("a", f"{r}", 1.0, r) for r in (3.0, 2.99, 2.5, 2.0, 1.5, 1.49)])
    full = {r["Channel"]: (r["tier"], r["action"]) for r in records(dx.channel_tiers(rows))}
    assert full["3.0"] == ("Highly Efficient", "scale") and full["2.99"][0] == "Efficient"
    assert full["2.0"] == ("Efficient", "maintain") and full["1.5"] == ("Moderate", "monitor")
    assert full["1.49"] == ("Underperforming", "reduce")
    basic = {r["Channel"]: (r["tier"], r["action"]) for r in records(dx.channel_tiers(rows, "basic"))}
    assert basic["2.5"][0] == "Highly Efficient" and basic["2.0"] == ("Moderately Efficient", "maintain")
    assert basic["1.49"] == ("Underperforming", "cap")


def test_flags_and_plan(spark):
    summary = summary_of(spark, ("edge", 2.0, 2.0), ("over", 2.0, 2.0), ("one", 2.0, 2.0),
                         ("none", 2.0, 2.0))
    rows = channel_rows(spark, ("edge", "x", 5000.0, 3.0), ("edge", "y", 1.0, 1.0),
                        ("over", "x", 5000.01, 2.4), ("over", "y", 1.0, 1.0), ("one", "x", 300.0, 3.0))
    flags = {r["campaign_id"]: r for r in records(dx.risk_flags(summary, rows))}
    assert not flags["edge"]["is_saturating"] and flags["edge"]["is_concentrated"]
    assert not flags["over"]["is_saturating"]
    assert not flags["one"]["is_concentrated"]
    assert flags["none"]["best_channel"] == "None" and not flags["none"]["is_concentrated"]
    basic = {r["campaign_id"]: r for r in records(dx.risk_flags(summary, rows, style="basic"))}
    assert basic["over"]["is_saturating"] and not basic["edge"]["is_saturating"]
    plan = {r["campaign_id"]: r for r in records(dx.shift_plan(summary, rows))}
    assert (plan["edge"]["from_channel"], plan["edge"]["to_channel"]) == ("y", "x")
    assert plan["one"]["from_channel"] == "None" and plan["one"]["to_channel"] == "x"


def test_best_channel_default(spark):
    rows = channel_rows(spark, ("a", "x", 1.0, 0.0), ("b", "x", 1.0, 0.5))
    got = {r["campaign_id"]: r["best_channel"] for r in records(sm.best_channel(rows))}
    assert got == {"a": "Google Ads", "b": "x"}


def test_verdict(spark):
    totals = spark.createDataFrame(
        [("a", "up", 10.0, 30.0, 3.0), ("a", "same", 10.0, 20.0, 2.0), ("b", "zero", 1.0, 1.0, 1.0)],
        "campaign_id string, scenario_id string, TotalSpend double, TotalRevenue double, TotalROAS double")
    summary = summary_of(spark, ("a", 1.0, 2.0), ("b", 1.0, 0.0))
    got = {r["scenario_id"]: (r["uplift_pct"], r["improves"])
           for r in records(dx.scenario_verdict(totals, summary))}
    assert got == {"up": (50.0, True), "same": (0.0, False), "zero": (0.0, False)}


def test_story_and_prompt(spark, tmp_path):
    summary = summary_of(spark, ("a", 1.0, 2.0), ("empty", 1.0, 0.5))
    ranked = sm.rank_channels(channel_rows(spark, ("a", "x", 100.0, 3.5), ("a", "y", 900.0, 1.0)))
    totals = spark.createDataFrame(
        [("a", "s1", 10.0, 30.0, 3.0)],
        "campaign_id string, scenario_id string, TotalSpend double, TotalRevenue double, TotalROAS double")
    lines = nv.narrative(summary, ranked, totals)
    texts = [r["text"] for r in records(lines.where("campaign_id = 'a'"), "section", "line")]
    assert texts[2] == "- Revenue: $2,000.00 ahead, +100.0% on what was measured"
    assert texts[7:10] == ["### x", "- 3.50x on $100.00, $12.35 per conversion",
                           "- Class Highly Efficient, budget: more"]
    assert texts[12].endswith("budget: less")
    assert texts[-1] == "Above the forecast: yes"
    assert lines.where("campaign_id = 'empty'").count() == 6 + 1 + 3 + 5
    prompt = [r["text"] for r in records(nv.prompt_table(summary, ranked, totals)
                                         .where("campaign_id = 'a'"), "section", "line")]
    assert prompt[4].startswith("- x: spend $100.00") and prompt[6].startswith("Scenario s1")
    nv.write_texts(nv.narrative(summary, ranked), str(tmp_path / "texts"))
    folder = tmp_path / "texts" / "campaign_id=a"
    files = sorted(f for f in os.listdir(folder) if f.startswith("part"))
    written = "".join((folder / f).read_text() for f in files).splitlines()
    assert written == texts[:-3]


def test_intents(spark):
    texts = {"Optimize my BUDGET forecast": "allocation", "next month ROAS": "forecast",
             "the FUTURE": "forecast", "return": "return",
             "Which channel should I invest in?": "default", "": "default"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["intent"] for r in records(ms.route_messages(rows))} == texts


def test_answers(spark):
    summary = summary_of(spark, ("a", 1.5, 2.0))
    facts = ms.answer_facts(summary, channel_rows(spark, ("a", "x", 1.0, 3.0), ("a", "y", 1.0, 1.0)))
    messages = spark.createDataFrame(
        [("1", "a", "split my budget"), ("2", "a", "forecast?"), ("3", "a", "what return"),
         ("4", "a", "hi"), ("5", "unknown", "what return")],
        "message_id string, campaign_id string, text string")
    got = {r["message_id"]: r["answer"] for r in records(ms.answer_messages(messages, facts))}
    assert got["1"] == "Of 2 channels x at 3.00x returns most."
    assert got["2"] == "Expected in 30 days: $2,000.00 revenue, 2.00x return."
    assert got["3"].startswith("Measured return: 1.50x;")
    assert got["4"].startswith("Topics:")
    assert got["5"].startswith("Measured return: 2.10x;")


@pytest.mark.parametrize(
    "line, kind, text",
    [
        ("## head ## more", "heading", "head more"),
        ("  ### sub", "subheading", "sub"),
        ("- **b** x **y**", "bullet", "<b>b</b> x **y**"),
        ("* x", "bullet", "x"),
        ("1. one ** two", "paragraph", "1. one <b> two"),
        ("plain", "paragraph", "plain"),
        ("##no", "paragraph", "##no"),
    ])
def test_blocks(spark, line, kind, text):
    rows = spark.createDataFrame([(1, f"\n  \n{line}\n")], "id int, text string")
    got = records(nv.report_blocks(rows, ["id"]))
    assert [(r["line"], r["kind"], r["block_text"]) for r in got] == [(2, kind, text)]


def test_messages_are_answered_as_they_arrive(spark, tmp_path):
    summary = summary_of(spark, ("a", 1.5, 2.0))
    facts = ms.answer_facts(summary, channel_rows(spark, ("a", "x", 1.0, 3.0), ("a", "y", 1.0, 1.0)))
    schema = "message_id string, campaign_id string, text string"
    batches = [[("1", "a", "split my budget"), ("2", "a", "hi")], [("3", "b", "what return")]]
    paths = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(paths[0])
        stream = spark.readStream.schema(schema).json(paths[0])
        start_answers(stream, facts, *paths[1:]).awaitTermination()
    rows = spark.createDataFrame([row for batch in batches for row in batch], schema)
    expected = records(ms.answer_messages(rows, facts), "message_id")
    assert records(spark.read.parquet(paths[1]).select(list(expected[0])), "message_id") == expected


def test_basic_story(spark):
    summary = summary_of(spark, ("a", 1.0, 2.0))
    ranked = sm.rank_channels(channel_rows(spark, ("a", "x", 6000.0, 2.5), ("a", "y", 900.0, 1.0)))
    full = [r["text"] for r in records(nv.narrative(summary, ranked), "section", "line")]
    basic = [r["text"] for r in records(nv.narrative(summary, ranked, style="basic"), "section", "line")]
    assert any(t.startswith("- Class Efficient") for t in full)
    assert any(t.startswith("- Class Highly Efficient") for t in basic)
    assert "- Saturation: none" in full and "- Saturation: x" in basic
