"""Featured datasets of very many campaigns: folders by version and hash bucket, none per campaign.

``files.write_dataset`` has a folder per campaign, which suits thousands of them. Here each write
adds one version, a folder of the buckets it touches, and the newest version of a campaign counts:
replacing a campaign writes its rows and nothing else, and a write that did not finish is not seen.
Inside a bucket rows are in order of campaign and files carry a bloom filter on it, so a reader of
one campaign opens its bucket and skips the row groups without it. ``merge_versions`` keeps the
versions few.

One writer at a time; readers go on beside it, except of versions that a merge removes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.operators.spread import attach
from adlens.schema import FEATURED_SCHEMA

#: Buckets of a new dataset: some gigabytes each at 100 TB.
BUCKETS = 4096

_OWN = (T.StructField("_version", T.LongType()), T.StructField("_bucket", T.IntegerType()))


def _bucket(campaign: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(campaign), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the folder as one of its objects."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets a dataset was begun with; it is part of its folder's name."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    found = [int(n.removeprefix("buckets=")) for n in names if n.startswith("buckets=")]
    return found[0] if found else None


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders of the finished versions by number."""
    buckets = _buckets(spark, path)
    if buckets is None:
        return {}
    files, folder = _folder(spark, f"{path}/buckets={buckets}")
    found = {}
    for status in files.listStatus(folder):
        place = status.getPath()
        done = spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        if place.getName().startswith("_version=") and files.exists(done):
            found[int(place.getName().removeprefix("_version="))] = place.toString()
    return found


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    """Add a version; one that an earlier try left unfinished under the same number is replaced."""
    number = max(versions(rows.sparkSession, path), default=0) + 1
    placed = rows.select(*FEATURED_SCHEMA.names).withColumn("_bucket", _bucket(F.col("campaign_id"), buckets))
    ordered = placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "campaign_id", "Date", "Channel")
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
     .option("parquet.bloom.filter.enabled#campaign_id", "true").partitionBy("_bucket")
     .parquet(f"{path}/buckets={buckets}/_version={number}"))


def write_buckets(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store featured rows; the campaigns written are replaced as a whole, others stay.

    ``buckets`` is chosen with the first write and holds for the dataset from then on. An empty
    table replaces nothing. Rows without a campaign or a date are refused.
    """
    begun = _buckets(df.sparkSession, path)
    if begun is not None and buckets not in (None, begun):
        raise ValueError(f"The dataset at {path} has {begun} buckets")
    named = F.col("campaign_id").isNotNull() & F.col("Date").isNotNull()
    told = F.when(named, F.col("campaign_id")).otherwise(F.raise_error(F.lit("row without campaign or date")))
    _write(df.withColumn("campaign_id", told), path, begun or buckets or BUCKETS)


def remove_campaigns(campaigns: DataFrame, path: str) -> None:
    """Remove the campaigns of a table with ``campaign_id``: a version in which they have no day."""
    begun = _buckets(campaigns.sparkSession, path)
    if begun is None:
        raise LookupError(f"No dataset at {path}")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in FEATURED_SCHEMA.fields if f.name != "campaign_id"]
    _write(campaigns.select("campaign_id").where("campaign_id IS NOT NULL").distinct().select("*", *empty), path, begun)


def _stored(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    schema = T.StructType([*FEATURED_SCHEMA.fields, *_OWN])
    root = f"{path}/buckets={_buckets(spark, path)}"
    return spark.read.schema(schema).option("basePath", root).parquet(*folders)


def _newest(spark: SparkSession, path: str, found: dict[int, str]) -> DataFrame:
    """Rows of the newest version of each campaign, removed ones included.

    Only the campaigns of the versions after the oldest are looked up, so the large first version
    is read once and, while the later ones are small, is not shuffled.
    """
    stored = _stored(spark, path, list(found.values()))
    later = [found[v] for v in sorted(found)[1:]]
    if not later:
        return stored
    last = _stored(spark, path, later).groupBy("campaign_id").agg(F.max("_version").alias("_last"))
    whole = attach(stored, last, ["campaign_id"], by=["Date", "Channel"])
    return whole.where(F.col("_last").isNull() | (F.col("_version") == F.col("_last"))).drop("_last")


def read_buckets(spark: SparkSession, path: str, campaign_id: str | None = None) -> DataFrame:
    """Stored rows; of one campaign when named, from its bucket of the version that counts."""
    found = versions(spark, path)
    if not found:
        raise LookupError(f"No dataset at {path}")
    if campaign_id is None:
        return _newest(spark, path, found).where("Date IS NOT NULL").select(*FEATURED_SCHEMA.names)
    place = spark.range(1).select(_bucket(F.lit(campaign_id), _buckets(spark, path))).first()[0]
    own = _stored(spark, path, list(found.values())).where((F.col("_bucket") == place) & (F.col("campaign_id") == campaign_id))
    last = own.agg(F.max("_version")).first()[0]
    rows = own.where((F.col("_version") == F.lit(last)) & F.col("Date").isNotNull())
    if last is None or rows.isEmpty():
        raise LookupError(f"Campaign {campaign_id} not found at {path}")
    return rows.select(*FEATURED_SCHEMA.names)


def merge_versions(spark: SparkSession, path: str, since: int = 0) -> None:
    """Make one version of those from number ``since`` on; 0 takes all.

    The new version holds the newest rows of each campaign and is finished before the others are
    removed; a run that stops in between leaves rows that no longer count. Merging only the late,
    small versions leaves the large ones where they are; removed campaigns stay marked until all
    versions are merged.
    """
    found = {v: f for v, f in versions(spark, path).items() if v >= since}
    if len(found) < 2:
        return
    everything = len(found) == len(versions(spark, path))
    rows = _newest(spark, path, found)
    _write(rows.where("Date IS NOT NULL") if everything else rows, path, _buckets(spark, path))
    for folder in found.values():
        files, place = _folder(spark, folder)
        files.delete(place, True)
