"""Log of what a stream's batches brought: rows by batch and by a hash bucket of the campaign.

A batch replaces what an earlier try of it wrote and touches no other batch. A reader of some
campaigns opens their buckets only; there is no folder per campaign, so millions of them do not
multiply files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.sources.files import of_campaigns

#: Folders of a log.
BUCKETS = 64

_OWN = (T.StructField("_bucket", T.IntegerType()), T.StructField("batch_id", T.LongType()))


def bucket_of(campaign: Column) -> Column:
    return F.pmod(F.xxhash64(campaign), F.lit(BUCKETS)).cast("int")


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of a batch, in order of campaign so that files tell which ones they hold."""
    placed = rows.withColumns({"_bucket": bucket_of(F.col("campaign_id")), "batch_id": F.lit(batch_id).cast("bigint")})
    ordered = placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "campaign_id")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("_bucket", "batch_id").parquet(path)


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, names: Sequence[str]
) -> DataFrame:
    """All rows of the named campaigns with the ``batch_id`` they came in; ``schema`` is that of the
    rows as they were written. The names are those of a batch, a bounded list on the driver."""
    whole = T.StructType([*schema.fields, *_OWN])
    wanted = spark.createDataFrame([(n,) for n in names], "campaign_id string")
    buckets = [row[0] for row in wanted.select(bucket_of(F.col("campaign_id"))).distinct().collect()]
    stored = spark.read.schema(whole).parquet(path).where(F.col("_bucket").isin(buckets))
    return of_campaigns(stored, names).drop("_bucket")
