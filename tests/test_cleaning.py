"""Cleaning of a dirty file, with the reading rules of text and number columns."""

import datetime
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from adlens.functions.numbers import as_bare_digits, as_number, as_signed, is_text
from adlens.functions.text import canonical_channel, strip_space
from adlens.operators import cleaning as cl
from adlens.sources.files import read_campaign_csv, read_campaign_layouts

from conftest import records

DIRTY = """ date ,PLATFORM,spend,Impressions,clicks,Conversions,revenue
2026-01-01, google ads ,$100,1000,50,5,500
2026-01-01,GOOGLE ADS,"$1,000",2000,-10,N/A,700
06/02/2026,Meta,5,1,1,1,1
2026-01-02,o'neil,-$5,100,10,1,20
2026-01-02,,7,0,0,0,0
2026-01-03,web2go,abc,50,5,2.5,30
"""


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dirty")
    (folder / "march.csv").write_text(DIRTY)
    return read_campaign_csv(spark, str(folder))


EXPECTED = [
    ("2026-01-01", "Google Ads", 1100.0, 3000.0, 50.0, 5.0, 1200.0),
    ("2026-01-02", "Nan", 7.0, 0.0, 0.0, 0.0, 0.0),
    ("2026-01-02", "O'Neil", 5.0, 100.0, 10.0, 1.0, 20.0),
    ("2026-01-03", "Web2Go", 0.0, 50.0, 5.0, 2.5, 30.0),
]


def as_tuples(df):
    return [
        (str(r["Date"]), r["Channel"], *[r[c] for c in cl.MEASURES])
        for r in records(df, "Date", "Channel")
    ]


def test_clean(dirty):
    assert as_tuples(cl.clean(dirty)) == EXPECTED
    assert {r["campaign_id"] for r in records(cl.clean(dirty))} == {"march"}


def test_clean_step_by_step(dirty):
    rows = cl.clean_numeric(cl.parse_dates(dirty), typed_by=dirty)
    rows = rows.withColumn("Channel", canonical_channel(F.col("Channel")))
    assert as_tuples(cl.merge_duplicates(rows)) == EXPECTED


def test_audit(dirty):
    found = {(r["step"], r["column"]): r["n_rows"] for r in records(cl.cleaning_audit(dirty))}
    assert found[("loaded", "")] == 6 and found[("bad_date", "Date")] == 1
    assert found[("duplicate", "")] == 1 and found[("final", "")] == 4
    assert found[("null", "Spend")] == 1 and found[("null", "Conversions")] == 1
    assert found[("negative", "Clicks")] == 1
    assert found[("renamed", "Platform")] == 6
    assert sum(found.values()) == 6 + 6 + 1 + 1 + 4 + 2 + 1


def test_repairs_are_observed_while_cleaning(dirty):
    observation = Observation("cleaning")
    assert as_tuples(cl.clean(dirty, observation=observation)) == EXPECTED
    seen = cl.observed_repairs(observation)
    audit = {(r["step"], r["column"]): r["n_rows"] for r in records(cl.cleaning_audit(dirty))}
    assert seen == {k: v for k, v in audit.items() if k[0] not in ("renamed", "duplicate", "final")}


def test_strict_keeps_the_sign(dirty):
    spend = {r["Channel"]: r["Spend"] for r in records(cl.clean(dirty, mode="strict"))}
    assert spend["O'Neil"] == 0.0 and spend["Google Ads"] == 1100.0


def test_flags_look_at_rows_with_bad_dates_too(spark):
    columns = ["campaign_id", "Date", "Channel", *cl.MEASURES]
    raw = spark.createDataFrame(
        [("a", "never", "x", "$1", "1", "1", "1", "1"),
         ("a", "2026-01-01", "x", "-5", "1", "1", "1", "1"),
         ("b", "2026-01-01", "x", "-5", "1", "1", "1", "1")], columns,
    )
    spend = {r["campaign_id"]: r["Spend"] for r in records(cl.clean(raw))}
    assert spend == {"a": 5.0, "b": 0.0}


def test_number_readings(spark):
    rows = spark.createDataFrame(
        [(t,) for t in ("1e3", " 5 ", "-3", "(50)", "1.2.3", "5d", "0x1p3", ".5", "inf", "NA", "",
                        "$1,000.5", "abc")], "t string")
    t = F.col("t")
    found = {r["t"]: (r["n"], r["b"], r["s"], r["x"]) for r in rows.select(
        "t", as_number(t).alias("n"), as_bare_digits(t).alias("b"), as_signed(t).alias("s"),
        is_text(t).alias("x")).collect()}
    assert found["1e3"] == (1000.0, 13.0, 1000.0, False)
    assert found[" 5 "][:2] == (5.0, 5.0)
    assert found["-3"] == (-3.0, 3.0, -3.0, False)
    assert found["(50)"] == (None, 50.0, -50.0, True)
    assert found["1.2.3"] == (None, None, None, True)
    assert found["5d"] == (None, 5.0, None, True)
    assert found["0x1p3"][0] is None
    assert found[".5"][0] == 0.5 and found["inf"][0] == float("inf")
    assert found["NA"] == (None, None, None, False) and found[""] == (None, None, None, False)
    assert found["$1,000.5"] == (None, 1000.5, 1000.5, True)
    assert found["abc"] == (None, None, None, True)


@pytest.mark.parametrize(
    "text", ["o'neil", "web2go", "google-ads", "LinkedIn Ads", "  tikTok\t", "a1b2 c_d", "ÉTÉ été",
             "nan", "x\ty"])
def test_title_case_is_that_of_python(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(canonical_channel(F.col("t"))).first()
    assert got[0] == text.strip().title()


def test_strip_takes_every_white_space(spark):
    for text in ("\t a b \n", " x ", "\x1cx\x1f"):
        got = spark.createDataFrame([(text,)], "t string").select(strip_space(F.col("t"))).first()
        assert got[0] == text.strip()


def test_dates(spark):
    texts = ["2026-06-01", "2026-6-2", "2026-02-30", "06/03/2026", "2026-06-04 13:00:00", "NA"]
    rows = spark.createDataFrame([(t,) for t in texts], "Date string")
    kept = {r["Date"] for r in cl.parse_dates(rows).collect()}
    assert kept == {datetime.date(2026, 6, 1), datetime.date(2026, 6, 2)}
    assert cl.parse_dates(rows, ("yyyy-M-d", "M/d/yyyy")).count() == 3
    stamped = cl.parse_dates(rows, ("yyyy-M-d", "yyyy-M-d HH:mm:ss"), grain="timestamp")
    assert datetime.datetime(2026, 6, 4, 13) in {r["Date"] for r in stamped.collect()}


def test_header(spark):
    frame = spark.createDataFrame([("a", "b")], " date , channel ".split(","))
    assert cl.normalize_header(frame).columns == ["Date", "Channel"]
    both = spark.createDataFrame([("a", "b")], ["platform", "channel"])
    assert cl.normalize_header(both).columns == ["Platform", "Channel"]
    with pytest.raises(ValueError, match="more than once"):
        cl.normalize_header(spark.createDataFrame([("a", "b")], ["date ", "Date"]))
    with pytest.raises(ValueError, match="Spend, Impressions"):
        cl.require_columns(both)


def write(folder, name, text):
    (folder / name).write_text(text)
    return os.path.join(str(folder), name)


HEAD = "Date,Channel,Spend,Impressions,Clicks,Conversions,Revenue\n"


def test_files_with_other_headers_are_not_read_by_position(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "2026-01-01,x,1,2,3,4,5\n")
    write(tmp_path, "b.csv", "Channel,Date,Revenue,Spend,Impressions,Clicks,Conversions,Note\n"
                             "y,2026-01-02,50,10,20,30,40,hello\n")
    with pytest.raises(Exception):
        read_campaign_csv(spark, str(tmp_path)).collect()
    rows = cl.clean(read_campaign_layouts(spark, str(tmp_path)))
    assert as_tuples(rows) == [
        ("2026-01-01", "X", 1.0, 2.0, 3.0, 4.0, 5.0),
        ("2026-01-02", "Y", 10.0, 20.0, 30.0, 40.0, 50.0),
    ]
    assert {r["campaign_id"] for r in records(rows)} == {"a", "b"}


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="csv"):
        read_campaign_csv(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        read_campaign_csv(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="Revenue"):
        read_campaign_csv(spark, write(tmp_path, "short.csv", "Date,Channel,Spend\n1,2,3\n"))
    long_row = write(tmp_path, "long.csv", HEAD + "2026-01-01,x,1,2,3,4,5,6\n")
    with pytest.raises(Exception, match="too many fields"):
        read_campaign_csv(spark, long_row).collect()
    short_row = write(tmp_path, "few.csv", HEAD + "2026-01-01,x,1,2\n")
    assert as_tuples(cl.clean(read_campaign_csv(spark, short_row))) == [
        ("2026-01-01", "X", 1.0, 2.0, 0.0, 0.0, 0.0)]


def test_byte_order_mark_line_breaks_and_quotes(spark, tmp_path):
    text = "\ufeff" + HEAD.replace("\n", ",Note\r\n")
    text += '2026-01-01,"say ""x""",1,2,3,4,5,"two\nlines"\r\n\r\n2026-01-02,y,1,2,3,4,5,\r\n'
    path = write(tmp_path, "notes.csv", text)
    rows = as_tuples(cl.clean(read_campaign_csv(spark, path, multi_line=True)))
    assert [r[:3] for r in rows] == [("2026-01-01", 'Say "X"', 1.0), ("2026-01-02", "Y", 1.0)]


def test_rows_are_read_where_they_lie(spark):
    """The text columns of a campaign come to its rows: no shuffle gathers them in one task."""
    number = F.col("id")
    raw = spark.range(5000).select(
        F.when(number % 2 == 0, "a").otherwise("b").alias("campaign_id"),
        F.lit("2026-01-01").alias("Date"), F.lit("x").alias("Channel"),
        F.when(number == 8, "$8").when(number % 5 == 0, "-3").otherwise("4").alias("Spend"),
        *[F.lit("1").alias(c) for c in cl.MEASURES[1:]],
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = cl.clean_numeric(cl.parse_dates(raw), typed_by=raw)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    # Campaign a holds a text, so its minus signs go; those of b make zero.
    sums = {r[0]: r[1] for r in rows.groupBy("campaign_id").agg(F.sum("Spend")).collect()}
    assert sums == {"a": 8.0 + 500 * 3.0 + 1999 * 4.0, "b": 2000 * 4.0}
