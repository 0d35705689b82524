"""Datasets, catalog, whole ingest and streaming ingest."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from adlens.operators import features as ft
from adlens.operators import curve_state as cs, response as rc
from adlens.plans import pipelines as pl
from adlens.session import durable
from adlens.sources import buckets as bk, catalog as ct, files as fl, synthetic as sy
from adlens.streaming.ingest import read_campaign_stream, start_ingest

from conftest import records, sample_rows

HEAD = "Date,Channel,Spend,Impressions,Clicks,Conversions,Revenue\n"


def csv_text(rows):
    return HEAD + "".join(f"{r[1]},{r[2]},{','.join(str(v) for v in r[3:])}\n" for r in rows)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_dataset_round_trip(spark, sample, tmp_path, fmt):
    path = str(tmp_path / "store")
    featured = ft.engineer_features(sample)
    fl.write_dataset(featured, path, fmt)
    other = featured.withColumn("campaign_id", F.lit("007"))
    fl.write_dataset(other, path, fmt)
    back = fl.read_dataset(spark, path, "007", fmt)
    assert records(back, "Date", "Channel") == [
        {**r, "campaign_id": "007"} for r in
        [{c: row[c] for c in back.columns} for row in records(featured, "Date", "Channel")]]
    assert fl.read_dataset(spark, path, None, fmt).count() == 40
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(campaign_id" in plan
    with pytest.raises(LookupError):
        fl.read_dataset(spark, path, "nobody", fmt)
    with pytest.raises(LookupError):
        fl.read_dataset(spark, str(tmp_path / "nothing"), None, fmt)


def _named(rows, *names):
    """The same days under several campaigns."""
    return rows.withColumn("campaign_id", F.explode(F.lit(list(names))))


def _spends(df):
    return {r[0]: r[1] for r in df.groupBy("campaign_id").agg(F.sum("Spend")).collect()}


def test_buckets_versions(spark, sample, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(LookupError):
        bk.read_buckets(spark, path)
    with pytest.raises(LookupError):
        bk.remove_campaigns(sample, path)
    featured = ft.engineer_features(sample).cache()
    spend = featured.agg(F.sum("Spend")).first()[0]
    names = [f"k{i}" for i in range(40)]
    bk.write_buckets(_named(featured, *names), path, buckets=8)
    assert _spends(bk.read_buckets(spark, path)) == pytest.approx({n: spend for n in names})
    doubled = featured.withColumn("Spend", F.col("Spend") * 2)
    bk.write_buckets(_named(doubled.limit(7), "k3", "new"), path)  # fewer rows than before
    short = doubled.limit(7).agg(F.sum("Spend")).first()[0]
    bk.write_buckets(featured.limit(0), path)
    bk.remove_campaigns(spark.createDataFrame([("k5",), ("k5",), (None,), ("nobody",)], "campaign_id string"), path)
    expected = {n: spend for n in names if n != "k5"} | {"k3": short, "new": short}
    first = os.stat(f"{path}/buckets=8/_version=1").st_mtime_ns
    for since, left in ((2, 2), (0, 1)):  # the late versions alone, then all
        assert _spends(bk.read_buckets(spark, path)) == pytest.approx(expected)
        assert os.stat(f"{path}/buckets=8/_version=1").st_mtime_ns == first
        assert bk.read_buckets(spark, path, "k3").count() == 7
        with pytest.raises(LookupError):
            bk.read_buckets(spark, path, "k5")
        bk.merge_versions(spark, path, since)
        assert len(bk.versions(spark, path)) == left
    assert _spends(bk.read_buckets(spark, path)) == pytest.approx(expected)
    one = records(bk.read_buckets(spark, path, "k9"), "Date", "Channel")
    assert one == [{**{c: r[c] for c in one[0]}, "campaign_id": "k9"} for r in records(featured, "Date", "Channel")]
    bk.write_buckets(_named(featured, "k5"), path)
    assert bk.read_buckets(spark, path, "k5").count() == featured.count()


def test_buckets_refuse_and_prune(spark, sample, tmp_path):
    path = str(tmp_path / "store")
    featured = ft.engineer_features(sample)
    bk.write_buckets(featured, path, buckets=4)
    with pytest.raises(ValueError):
        bk.write_buckets(featured, path, buckets=8)
    for column in ("campaign_id", "Date"):
        with pytest.raises(Exception, match="row without campaign or date"):
            bk.write_buckets(featured.withColumn(column, F.lit(None).cast(featured.schema[column].dataType)), path)
    assert len(bk.versions(spark, path)) == 1  # writes that failed are not seen
    assert bk.read_buckets(spark, path).count() == featured.count()
    name = featured.first()["campaign_id"]
    plan = bk.read_buckets(spark, path, name)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert f"EqualTo(campaign_id,{name})" in plan


def test_preview_and_records(sample):
    featured = ft.engineer_features(sample)
    first = records(fl.preview(featured), "Date", "Channel")
    assert len(first) == 15 and first[0]["Date"] == "2026-06-01"
    line = json.loads(fl.to_json_lines(featured).orderBy("value").first()["value"])
    assert line["Date"] == "2026-06-01" and line["Channel"] == "Google Ads"


def test_catalog(spark, sample, tmp_path):
    path = str(tmp_path / "catalog")
    entries = ct.catalog_entries(sample, "/somewhere")
    ct.catalog_upsert(entries.withColumn("updated_at", F.lit("2026-01-01 00:00:00")), path)
    late = entries.withColumn("updated_at", F.lit("2026-02-01 00:00:00")).withColumn(
        "total_spend", F.lit(1.0))
    ct.catalog_upsert(late, path)
    found = records(ct.catalog_lookup(spark, path, "sample"))
    assert len(found) == 1 and found[0]["total_spend"] == 1.0 and found[0]["channels_count"] == 2
    assert ct.catalog_lookup(spark, path, "nobody").count() == 0


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "june.csv").write_text(csv_text(sample_rows()))
    (tmp_path / "in" / "a+b 50% é.csv").write_text(csv_text(sample_rows()[:3]))
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    audit = pl.ingest(spark, str(tmp_path / "in"), store, catalog)
    june = audit.where("campaign_id = 'june'")
    assert {r["step"]: r["n_rows"] for r in records(june) if not r["column"]} == {
        "loaded": 20, "duplicate": 0, "final": 20}
    assert fl.read_dataset(spark, store, "a+b 50% é").count() == 3
    assert records(ct.catalog_lookup(spark, catalog, "a+b 50% é"))[0]["channels_count"] == 2
    assert fl.read_dataset(spark, store, "june").count() == 20
    entry = records(ct.catalog_lookup(spark, catalog, "june"))[0]
    assert entry["total_spend"] == 3590.0 and entry["filename"] == "june.csv"


def test_streaming_ingest_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    paths = {n: str(tmp_path / n) for n in ("facts", "store", "catalog", "checkpoint")}
    rows = sample_rows()

    def run():
        query = start_ingest(read_campaign_stream(spark, str(folder)), paths["facts"],
                             paths["store"], paths["catalog"], paths["checkpoint"])
        query.awaitTermination()

    (folder / "a.csv").write_text(csv_text(rows))
    (folder / "b.csv").write_text(csv_text(rows[:6]))
    run()
    assert fl.read_dataset(spark, paths["store"]).count() == 26
    (folder / "c d.csv").write_text(csv_text(rows[:4]))
    run()
    run()
    stored = fl.read_dataset(spark, paths["store"])
    assert {r["campaign_id"]: r["count"] for r in records(stored.groupBy("campaign_id").count())} == {
        "a": 20, "b": 6, "c d": 4}
    batch = pl.prepare(fl.read_campaign_csv(spark, str(folder / "a.csv")))
    streamed = stored.where("campaign_id = 'a'")
    assert records(streamed.select(batch.columns), "Date", "Channel") == records(
        batch, "Date", "Channel")
    assert ct.catalog_latest(ct.read_catalog(spark, paths["catalog"])).count() == 3


def test_later_rows_of_a_campaign_renew_its_features(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("facts", "store", "catalog", "checkpoint", "in")}
    os.makedirs(paths["in"] + "/1")
    os.makedirs(paths["in"] + "/2")
    rows = sample_rows()

    def run():
        start_ingest(read_campaign_stream(spark, paths["in"] + "/*"), paths["facts"],
                     paths["store"], paths["catalog"], paths["checkpoint"]).awaitTermination()

    with open(paths["in"] + "/1/a.csv", "w") as file:
        file.write(csv_text(rows[:14]))
    run()
    with open(paths["in"] + "/2/a.csv", "w") as file:
        file.write(csv_text(rows[14:]))
    run()
    stored = {(r["Date"], r["Channel"]): r for r in records(fl.read_dataset(spark, paths["store"]))}
    last = stored[(datetime.date(2026, 6, 10), "Google Ads")]
    assert len(stored) == 20 and last["Spend_Lag7"] == 140.0 and last["Spend_MA7"] == 155.0


def test_made_up_campaigns_do_not_depend_on_partitions(spark):
    names = spark.range(5).select(F.concat(F.lit("k"), "id").alias("campaign_id"))
    first = records(sy.synth_campaigns(names, "2026-05-31"), "campaign_id", "Date", "Channel")
    second = records(sy.synth_campaigns(names.repartition(3), "2026-05-31"),
                     "campaign_id", "Date", "Channel")
    assert len(first) == 5 * 60 * 4 and first == second
    google = [r for r in first if r["Channel"] == "Google Ads"]
    week = [r["Spend"] for r in google if r["Date"].weekday() < 5]
    rest = [r["Spend"] for r in google if r["Date"].weekday() >= 5]
    assert all(127 <= s <= 173 for s in week) and all(88 <= s <= 122 for s in rest)
    other = records(sy.synth_campaigns(names, "2026-05-31", seed=1), "campaign_id", "Date", "Channel")
    assert other != first


def test_durable_tables_are_in_the_shared_folder(spark, sample):
    kept = durable(sample)
    shared = spark.sparkContext.getCheckpointDir()
    assert all(shared.removeprefix("file:") in path for path in kept.inputFiles())
    assert records(kept, "Date", "Channel") == records(sample, "Date", "Channel")
    assert kept.schema.fieldNames() == sample.schema.fieldNames()

def test_each_file_has_its_own_date_format(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {
        "iso": ["2026-06-13", "2026-06-14", "06/15/2026"],
        "timed": ["2026-06-13 00:00:00", "2026-06-14 10:30:00", "2026-06-14"],
        "us": ["06/13/2026", "6/2/2026", "06/02/2026", "soon"],
        "eu": ["13/06/2026", "2/6/2026"],
        "unclear": ["1/2/2026"],
        "nothing": ["soon", ""],
    }
    for name, days in files.items():
        (tmp_path / "in" / f"{name}.csv").write_text(HEAD + "".join(f"{d},x,1,2,3,4,5\n" for d in days))
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    audit = records(pl.ingest(spark, str(tmp_path / "in"), store, catalog))
    stored = records(fl.read_dataset(spark, store))
    got = {}
    for r in stored:
        got.setdefault(r["campaign_id"], {})[str(r["Date"])] = r["Spend"]
    assert got == {
        "iso": {"2026-06-13": 1.0, "2026-06-14": 1.0},
        "timed": {"2026-06-13": 1.0, "2026-06-14": 1.0},
        "us": {"2026-06-13": 1.0, "2026-06-02": 2.0},
        "eu": {"2026-06-13": 1.0, "2026-06-02": 1.0},
        "unclear": {"2026-01-02": 1.0},
    }
    told = {(r["campaign_id"], r["step"], r["column"]): r["n_rows"] for r in audit}
    assert told["us", "date_format", "M/d/yyyy"] == 3 and told["us", "bad_date", "Date"] == 1
    assert told["us", "duplicate", ""] == 1 and told["us", "final", ""] == 2
    assert told["eu", "date_format", "d/M/yyyy"] == 2
    assert told["timed", "date_format", "yyyy-M-d H:m:s"] == 2 and told["timed", "bad_date", "Date"] == 1
    assert told["nothing", "date_format", "yyyy-M-d"] == 0
    assert {k for k in told if k[1] == "date_tie"} == {("unclear", "date_tie", "d/M/yyyy")}


def test_equal_file_names_are_refused_or_told_apart(spark, tmp_path):
    for folder in ("a", "b c"):
        os.makedirs(tmp_path / "in" / folder)
        (tmp_path / "in" / folder / "data.csv").write_text(csv_text(sample_rows()[:4]))
    paths = [str(tmp_path / "in" / f) for f in ("a", "b c")]
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    with pytest.raises(ValueError, match="data"):
        pl.ingest(spark, paths, store, catalog)
    assert not os.path.exists(store)
    pl.ingest(spark, paths, store, catalog, id_from="path")
    entries = records(ct.read_catalog(spark, catalog), "campaign_id")
    assert [e["campaign_id"].rsplit("/", 2)[1:] for e in entries] == [["a", "data"], ["b c", "data"]]
    assert [e["filename"] for e in entries] == ["data.csv"] * 2
    assert fl.read_dataset(spark, store, entries[1]["campaign_id"]).count() == 4


def test_mixed_headers_and_quoted_breaks_in_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + '2026-01-01,"Google\nAds",100,2,3,4,5\n')
    (tmp_path / "in" / "b.csv").write_text(
        "Note, platform ,Date,Revenue,Spend,Impressions,Clicks,Conversions\n"
        '"n ""1""",y,02/13/2026,50,10,20,30,40\n')
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    with pytest.raises(Exception, match="multi_line"):
        pl.ingest(spark, str(tmp_path / "in" / "a.csv"), store, catalog)
    pl.ingest(spark, str(tmp_path / "in"), store, catalog, multi_line=True, mixed_headers=True)
    rows = records(fl.read_dataset(spark, store), "campaign_id")
    assert [(r["campaign_id"], r["Channel"], str(r["Date"]), r["Spend"], r["Revenue"]) for r in rows] == [
        ("a", "Google\nAds", "2026-01-01", 100.0, 5.0), ("b", "Y", "2026-02-13", 10.0, 50.0)]
    (tmp_path / "in" / "c.csv").write_text(HEAD + "2026-01-01,x,1,2,3,4,5,6\n")
    with pytest.raises(Exception, match="too many fields"):
        pl.ingest(spark, str(tmp_path / "in"), store, catalog, multi_line=True, mixed_headers=True)


def test_a_stream_refuses_cut_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + '2026-01-01,"Google\nAds",100,2,3,4,5\n')

    def run(number, **options):
        paths = [str(tmp_path / f"{n}{number}") for n in ("facts", "store", "catalog", "checkpoint")]
        start_ingest(read_campaign_stream(spark, str(folder), **options), *paths).awaitTermination()
        return records(fl.read_dataset(spark, paths[1]))

    with pytest.raises(Exception, match="multi_line"):
        run(1)
    assert [(r["Channel"], r["Spend"]) for r in run(2, multi_line=True)] == [("Google\nAds", 100.0)]


def stream(spark, folder, tmp_path, **options):
    paths = [str(tmp_path / n) for n in ("facts", "store", "catalog", "checkpoint")]
    start_ingest(read_campaign_stream(spark, str(folder)), *paths, **options).awaitTermination()
    return fl.read_dataset(spark, paths[1])


def as_run_of_all(spark, folder, back):
    """The features of one run over all files of a folder as one campaign."""
    raw = fl.read_campaign_csv(spark, str(folder)).withColumn("campaign_id", F.lit("a"))
    whole = pl.prepare(raw)
    return records(whole.select(back.columns), "Date", "Channel")


def test_decisions_of_a_stream_are_those_of_all_batches(spark, tmp_path):
    """Formats and text columns change their mind with later batches, both ways."""
    for n in range(4):
        (tmp_path / f"in{n}").mkdir()
    texts = [
        HEAD + "3/4/2024,x,-5,1,1,1,1\n3/5/2024,x,7,1,1,1,1\n",  # M/d/yyyy and d/M/yyyy, a number column
        HEAD + "25/3/2024,x,9,1,1,1,1\n26/3/2024,x,-8,1,1,1,1\n",  # d/M/yyyy
        HEAD + "27/3/2024,y,$4,1,1,1,1\nno date,y,4,1,1,1,1\n",  # now spend is text: -5 means 5
        HEAD + "".join(f"2024-05-{d:02d},x,{d},1,1,1,1\n" for d in range(1, 9)),  # now ISO reads most
    ]
    (tmp_path / "all").mkdir()
    for n, text in enumerate(texts):
        (tmp_path / f"in{n}" / "a.csv").write_text(text)
        (tmp_path / "all" / f"{n}.csv").write_text(text)
        back = stream(spark, tmp_path / "in*", tmp_path)
        # The folders of later batches are still empty.
        assert records(back, "Date", "Channel") == as_run_of_all(spark, tmp_path / "all", back)
    assert {r["Date"].month for r in records(back)} == {5}


def test_a_late_day_leaves_the_files_of_earlier_months(spark, tmp_path):
    import glob
    import os

    start = datetime.date(2024, 1, 1)
    days = [start + datetime.timedelta(days=i) for i in range(0, 120, 2)]
    late = [datetime.date(2024, 3, 12), datetime.date(2024, 3, 12)]

    def text(dates, spend):
        return HEAD + "".join(f"{d},{c},{spend + d.day},10,2,1,{7 * d.day}\n" for d in dates for c in "xy")

    (tmp_path / "all").mkdir()
    (tmp_path / "in1").mkdir()
    (tmp_path / "in2").mkdir()

    def arrive(number, body):
        (tmp_path / f"in{number}" / "a.csv").write_text(body)
        (tmp_path / "all" / f"{number}.csv").write_text(body)
        return stream(spark, tmp_path / "in*", tmp_path)

    arrive(1, text(days, 100))
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(str(tmp_path / "store/*/*/*.parquet"))}
    months = {f.split("_month=")[1][:7] for f in files}
    assert months == {"2024-01", "2024-02", "2024-03", "2024-04"}
    back = arrive(2, text(late, 5))
    assert records(back, "Date", "Channel") == as_run_of_all(spark, tmp_path / "all", back)
    kept = {f for f in files if os.path.exists(f) and os.stat(f).st_mtime_ns == files[f]}
    assert {f.split("_month=")[1][:7] for f in kept} == {"2024-01", "2024-02"}


def test_refreshed_features_look_back_far_enough(spark, sample):
    whole = ft.engineer_features(sample)
    for since in ("2026-06-01", "2026-06-03", "2026-06-10", "2026-06-30"):
        spans = spark.createDataFrame([("sample",)], "campaign_id string").withColumn("since", F.lit(since).cast("date"))
        got = ft.refreshed_features(sample.where(F.col("Date") >= since), whole, spans)
        assert records(got.select(whole.columns), "Date", "Channel") == records(
            whole.where(F.col("Date") >= since), "Date", "Channel")


def test_lookup_reads_a_bucket_and_the_log(spark, sample, tmp_path):
    path = str(tmp_path / "catalog")
    names = [f"k{i}" for i in range(40)]
    copies = spark.createDataFrame([(n,) for n in names], "name string")
    many = sample.crossJoin(copies).withColumn("campaign_id", F.col("name")).drop("name")

    def found():
        return {n: records(ct.catalog_lookup(spark, path, n))[0]["total_spend"] for n in ("k3", "k7")}

    ct.catalog_upsert(ct.catalog_entries(many.withColumn("Spend", F.lit(1.0)), "store"), path)
    assert found() == {"k3": 20.0, "k7": 20.0}
    ct.compact_catalog(spark, path)
    assert found() == {"k3": 20.0, "k7": 20.0}
    ct.catalog_upsert(ct.catalog_entries(many.where("campaign_id = 'k3'").withColumn("Spend", F.lit(2.0)), "store"), path)
    assert found() == {"k3": 40.0, "k7": 20.0}
    for _ in range(2):
        ct.compact_catalog(spark, path)
    assert found() == {"k3": 40.0, "k7": 20.0}
    assert ct.catalog_latest(ct.read_catalog(spark, path)).count() == 40
    looked = ct.catalog_lookup(spark, path, "k7")
    assert len({f.split("_bucket=")[1].split("/")[0] for f in looked.inputFiles()}) > 1  # before pruning
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan
    assert ct.catalog_lookup(spark, path, "nobody").count() == 0


def test_curve_state_follows_changed_days(spark, sample, tmp_path):
    path = str(tmp_path / "state")
    fitted = records(rc.fit_curves(sample, merged=True), "Channel")
    late, meta = F.col("Date") > "2026-06-08", F.col("Channel") == "Meta Ads"
    cs.update_state(sample.where(~late), None, path, 0)
    extra = sample.where(meta).withColumn("Channel", F.lit("Gone"))
    cs.update_state(sample.where(late).unionByName(extra), None, path, 1)
    cs.update_state(extra.limit(0), extra, path, 2)
    got = records(cs.curves_of_state(cs.read_state(spark, path)), "Channel")
    assert [r["Channel"] for r in got] == ["Google Ads", "Meta Ads"]
    for ours, theirs in zip(got, fitted):
        assert all(v == (pytest.approx(theirs[n]) if isinstance(v, float) else theirs[n]) for n, v in ours.items())
