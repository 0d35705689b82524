"""Campaign catalog: a log of entries, the last entry of a campaign counts.

Writers append to the log. ``compact_catalog`` folds it into a snapshot in buckets by a hash of the
campaign; a lookup then reads one bucket and what was logged since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.operators.summary import dataset_summary
from adlens.schema import CATALOG_SCHEMA, KEYS
from adlens.sources.batches import bucket_of

# Folder of the snapshots; readers of the log pass over names that begin like this.
_SNAPSHOT = "_snapshot"


def catalog_entries(
    facts: DataFrame, storage_path: str | Column, files: DataFrame | None = None
) -> DataFrame:
    """One entry per campaign of ``facts`` with its summary, stamped with the current time.

    ``files`` names the uploaded file of each campaign (``cleaning.files_of_profile``); campaigns
    that came without a file have none. The channel names stay in the dataset itself
    (``summary.channels``): an entry has a fixed size whatever the number of channels.
    """
    path = F.lit(storage_path) if isinstance(storage_path, str) else storage_path
    summaries = dataset_summary(facts)
    if files is None:
        named = summaries.withColumn("filename", F.lit(None).cast("string"))
    else:
        named = summaries.join(files.select("campaign_id", "filename"), "campaign_id", "left")
    return named.select(
        "campaign_id",
        "filename",
        path.alias("storage_path"),
        "total_spend",
        "total_revenue",
        "total_conversions",
        "overall_roas",
        "channels_count",
        F.current_timestamp().alias("updated_at"),
    )


def catalog_upsert(entries: DataFrame, path: str) -> None:
    """Append entries; nothing is read or rewritten, so writers do not disturb each other."""
    columns = [F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA.fields]
    entries.select(*columns).write.mode("append").parquet(path)


def _snapshots(spark: SparkSession, path: str):
    """The folders of finished snapshots by number, and the file system they are on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_SNAPSHOT}")
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(root):
        return {}, files
    folders = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().isdigit()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return {int(f.getName()): f for f in folders if files.exists(done(f, "_SUCCESS"))}, files


def _logged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)  # does not look into the snapshots


def _snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    found, _ = _snapshots(spark, path)
    if not found:
        return None
    schema = T.StructType([*CATALOG_SCHEMA.fields, T.StructField("_bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(found[max(found)].toString())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All entries that may count: the snapshot and the log since."""
    snapshot = _snapshot(spark, path)
    logged = _logged(spark, path)
    return logged if snapshot is None else snapshot.drop("_bucket").unionByName(logged)


def compact_catalog(spark: SparkSession, path: str) -> None:
    """Fold the log into a new snapshot; one caller at a time, writers and readers go on meanwhile.

    The files folded are removed after the snapshot is finished, and so are snapshots before the
    last, which readers may still be using. A run that stops in between leaves entries twice, which
    is harmless since the newest one counts.
    """
    folded = _logged(spark, path).inputFiles()
    found, files = _snapshots(spark, path)
    if not folded:
        return
    schema = T.StructType(CATALOG_SCHEMA.fields)
    entries = spark.read.schema(schema).parquet(*folded)
    before = _snapshot(spark, path)
    whole = entries if before is None else before.drop("_bucket").unionByName(entries)
    placed = catalog_latest(whole).withColumn("_bucket", bucket_of(F.col("campaign_id")))
    number = max(found, default=0) + 1
    ordered = placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "campaign_id")
    ordered.write.partitionBy("_bucket").parquet(f"{path}/{_SNAPSHOT}/{number}")
    for name in folded:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)), False)
    for old in sorted(found)[:-1]:
        files.delete(found[old], True)


def catalog_latest(entries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest entry per campaign, as an aggregate: many versions of one campaign are reduced
    before the shuffle."""
    rest = [c for c in entries.columns if c not in keys and c != "updated_at"]
    newest = F.max(F.struct("updated_at", *rest)).alias("_newest")
    return entries.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def catalog_lookup(spark: SparkSession, path: str, campaign_id: str) -> DataFrame:
    """The newest entry of one campaign, no rows if there is none.

    Reads its bucket of the snapshot and the log since.
    """
    own = F.col("campaign_id") == campaign_id
    found = _logged(spark, path).where(own)
    snapshot = _snapshot(spark, path)
    if snapshot is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(campaign_id))).first()[0]
        found = found.unionByName(snapshot.where((F.col("_bucket") == bucket) & own).drop("_bucket"))
    return catalog_latest(found)
