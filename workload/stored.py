"""Checked queries that go through files: CSV in, datasets, catalog, stream.

Each writes what Spark derives from the given tables to a folder of its own in the shared folder
and reads it back with the library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators import cleaning as cl, curve_state as cs, features as ft, summary as sm
from adlens.plans import pipelines as pl
from adlens.schema import DATE_FORMATS, MEASURES, REQUIRED_COLUMNS
from adlens.session import durable, tables_folder
from adlens.sources import adapters as ad, buckets as bk, catalog as ct, files as fl
from adlens.streaming.ingest import read_campaign_stream, start_ingest


def _own_folder(spark: SparkSession) -> str:
    return f"{tables_folder(spark)}/{uuid.uuid4().hex}"


def _as_csv(rows: DataFrame, path: str) -> str:
    """Spark writes several files; blanks around values stay as they are."""
    writer = rows.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _one_campaign(raw: DataFrame, name: str = "dirty") -> DataFrame:
    """All files of a folder as one campaign."""
    return raw.withColumn("campaign_id", F.lit(name))


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty rows under padded, lower-case headers with ``Platform``, read and cleaned."""
    dirty = ad.dirty_events(spark, folder).select(*REQUIRED_COLUMNS)
    names = [f" {c.lower()} " if c != "Channel" else "PLATFORM" for c in REQUIRED_COLUMNS]
    path = _as_csv(dirty.toDF(*names), _own_folder(spark))
    return cl.clean(_one_campaign(fl.read_campaign_csv(spark, path)))


def ingest_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty rows in files of three column orders, two of them with columns of their own."""
    dirty = ad.dirty_events(spark, folder)
    orders = (
        REQUIRED_COLUMNS,
        (*reversed(REQUIRED_COLUMNS), "event_id"),
        ("event_id", *REQUIRED_COLUMNS[3:], *REQUIRED_COLUMNS[:3]),
    )
    root = _own_folder(spark)
    paths = [
        _as_csv(dirty.where(F.col("event_id") % 3 == i).select(*order), f"{root}/{i}")
        for i, order in enumerate(orders)
    ]
    return cl.clean(_one_campaign(fl.read_campaign_layouts(spark, paths)))


def ingest_quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty rows whose quoted channel names contain a line break."""
    broken = F.concat(F.lit("web\n"), (F.col("event_id") % 7).cast("string"))
    rows = ad.dirty_events(spark, folder).withColumn("Channel", broken).select(*REQUIRED_COLUMNS)
    path = _as_csv(rows, _own_folder(spark))
    return cl.clean(_one_campaign(fl.read_campaign_csv(spark, path, multi_line=True)))


def clean_dates_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """Five campaigns that write their dates in five ways, each with dates in another's way."""
    return cl.clean(ad.dated_events(spark, folder), formats=DATE_FORMATS)


def date_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The format chosen for each of these campaigns."""
    return cl.date_audit_of_profile(cl.profile(ad.dated_events(spark, folder), formats=DATE_FORMATS))


def dataset_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Featured campaigns stored, one of them replaced, all read again, each by its name."""
    path = _own_folder(spark)
    featured = ft.engineer_features(ad.channel_facts(spark, folder))
    fl.write_dataset(featured.withColumn("Spend", F.lit(0.0)), path)
    fl.write_dataset(featured, path)
    first, second, third = (fl.read_dataset(spark, path, f"c_{i}") for i in range(3))
    return first.unionByName(second).unionByName(third)


def bucketed_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A campaign per user in hash buckets: all replaced but some, some removed, some of these back."""
    path = _own_folder(spark)
    facts = ad.user_facts(spark, folder)
    facts = facts.withColumns({"campaign_id": F.col("Channel"), "Channel": F.col("campaign_id")})
    featured = durable(ft.engineer_features(facts))
    name = F.col("campaign_id")
    bk.write_buckets(featured.withColumn("Spend", F.lit(0.0)), path, buckets=64)
    bk.write_buckets(featured.where(~name.endswith("3")), path)
    bk.remove_campaigns(featured.where(name.endswith("7")), path)
    bk.merge_versions(spark, path, since=2)
    bk.write_buckets(featured.where(name.endswith("17")), path)
    return bk.read_buckets(spark, path).select(*REQUIRED_COLUMNS, "campaign_id", "Month")


def catalog_after_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entries after the entries of two other states, folded into snapshots on the way."""
    path = _own_folder(spark)
    facts = ad.channel_facts(spark, folder)
    for factor in (0.5, 2.0, 1.0):
        state = facts.withColumns({c: F.col(c) * factor for c in MEASURES})
        ct.catalog_upsert(ct.catalog_entries(state, "store"), path)
        if factor > 1 or factor < 1:
            ct.compact_catalog(spark, path)
    return ct.catalog_latest(ct.read_catalog(spark, path)).drop("updated_at", "filename")


def curves_after_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of a state that began with wrong days, was corrected, folded, and got late days."""
    path = _own_folder(spark)
    facts = ad.channel_facts(spark, folder)
    day = F.dayofmonth("Date")
    early, wrong = day % 3 != 0, day % 5 == 0
    spoiled = facts.withColumn("Spend", F.col("Spend") * 2 + 1)
    cs.update_state(facts.where(early & ~wrong).unionByName(spoiled.where(early & wrong)), None, f"{path}/a", 0)
    cs.update_state(facts.where(early & wrong), spoiled.where(early & wrong), f"{path}/a", 1)
    cs.fold_state(spark, f"{path}/a", f"{path}/b")
    for _ in range(2):  # the second time replaces the first
        cs.update_state(facts.where(~early), None, f"{path}/b", 2)
    return cs.curves_of_state(cs.read_state(spark, f"{path}/b"))


def kept_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset held across two requests."""
    kept = pl.keep(ad.channel_facts(spark, folder))
    days = kept.groupBy("campaign_id").agg(F.count_distinct("Date").alias("days"))
    return sm.dataset_summary(kept).join(days, "campaign_id")


def stream_equals_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty rows that arrive as files of a stream, several batches of one campaign.

    Taken alone the batches would be read differently: the first has dates in another format only,
    the second no text among its spends, the third all else.
    """
    root = _own_folder(spark)
    dirty = ad.dirty_events(spark, folder)
    event = F.col("event_id")
    other, text = event % 89 == 0, (event % 31 == 0) | (event % 7 == 0)
    paths = [f"{root}/{name}" for name in ("facts", "store", "catalog", "checkpoint")]
    for number, part in enumerate((other, ~other & ~text, ~other & text)):
        _as_csv(dirty.where(part).select(*REQUIRED_COLUMNS), f"{root}/in/{number}")
        rows = _one_campaign(read_campaign_stream(spark, f"{root}/in/*"))
        start_ingest(rows, *paths, formats=("yyyy-M-d", "M/d/yyyy")).awaitTermination()
    return fl.read_dataset(spark, paths[1])


QUERIES = (
    csv_round_trip, ingest_layouts, ingest_quoted_breaks, clean_dates_per_file, date_formats,
    dataset_round_trip, bucketed_dataset, catalog_after_upserts, curves_after_updates, kept_dataset, stream_equals_batch,
)
