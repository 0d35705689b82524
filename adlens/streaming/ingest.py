"""Continuous upload: new campaign files are cleaned, featured and stored as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adlens.operators.cleaning import (
    facts_of_profile, file_traits, files_of_profile, first_days, merge_traits, normalize_header,
    profile, require_columns,
)
from adlens.operators.features import engineer_features, refreshed_features
from adlens.schema import DATE_FORMATS, KEYS, MEASURES, REQUIRED_COLUMNS
from adlens.session import durable
from adlens.sources.batches import append_batch, read_batches
from adlens.sources.catalog import catalog_entries, catalog_upsert
from adlens.sources.files import (
    drop_campaigns, identified, of_campaigns, read_dataset, write_dataset,
)


def read_campaign_stream(
    spark: SparkSession, folder: str, header: Sequence[str] = REQUIRED_COLUMNS,
    files_per_batch: int = 1000, multi_line: bool = False, id_from: str = "name",
) -> DataFrame:
    """Stream of text rows of the CSV files in ``folder``, named by ``header``.

    A stream has one fixed header (one stream per layout). Rows with too many fields, or cut by a
    line break inside quotes, fail the query as they do in ``read_campaign_csv``.
    """
    names = [*header, "_corrupt"]
    rows = (
        spark.readStream.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    too_long = F.col("_corrupt").isNotNull() & F.col(f"`{header[-1]}`").isNotNull()
    return require_columns(normalize_header(identified(rows, header[-1], too_long, id_from)))


def start_ingest(
    rows: DataFrame,
    facts_path: str,
    store: str,
    catalog: str,
    checkpoint: str,
    formats: Sequence[str] = DATE_FORMATS,
    mode: str = "compat",
) -> StreamingQuery:
    """Process all waiting files, then stop (start it again for the next ones).

    Files with one campaign id are parts of one campaign, in one batch or in several (the batch
    ``pipelines.ingest`` takes a file as a whole campaign and refuses a second one). Which columns
    are text, and which date format counts, is decided over all batches of a campaign: each batch
    logs its profile, with every reading of every number and date, under ``facts_path``, and its
    traits, a row per campaign. Their sums decide, so the result is that of one run over all files.

    As long as a batch changes no decision, only the months from its first date on are read from
    the log and written, with the few rows before them from the store; otherwise the campaign is
    made anew from the log. A repeated batch replaces what an earlier try wrote; a repeated catalog
    entry is harmless since the newest one counts. A stream keeps its formats and mode.
    """
    spark = rows.sparkSession
    profiles_path, traits_path = f"{facts_path}/profiles", f"{facts_path}/traits"
    decided = ["_format"] + ([f"_text_{c}" for c in MEASURES] if mode == "compat" else [])

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        profiled = durable(profile(batch, KEYS, formats, "day", mode))
        # A file is a campaign, so there are at most as many names as files in a batch.
        files = files_of_profile(profiled)
        touched = [row[0] for row in files.select("campaign_id").collect()]
        if not touched:
            return
        own = file_traits(profiled).drop("_format")
        append_batch(profiled, profiles_path, batch_id)
        append_batch(own, traits_path, batch_id)
        parts = read_batches(spark, traits_path, own.schema, touched)
        now = durable(merge_traits(parts, len(formats)))
        before = merge_traits(parts.where(F.col("batch_id") < batch_id), len(formats))
        same = F.lit(True)
        for c in decided:
            same &= F.col(c).eqNullSafe(F.col(f"old{c}"))
        old = before.select("campaign_id", *[F.col(c).alias(f"old{c}") for c in decided], F.lit(True).alias("_old"))
        never = F.lit("9999-12-31").cast("date")  # a batch without a date changes nothing
        since = F.when(same & F.col("_old"), F.coalesce(F.trunc("first", "month"), never))
        spans = durable(
            now.join(old, "campaign_id", "left")
            .join(first_days(profiled, now, KEYS, len(touched)), "campaign_id", "left")
            .select("campaign_id", since.alias("since"))
        )
        renewed = [row[0] for row in spans.where("since IS NULL").select("campaign_id").collect()]
        logged = read_batches(spark, profiles_path, profiled.schema, touched)
        recent = facts_of_profile(logged, KEYS, mode, len(touched), now.join(spans, "campaign_id"))
        if len(renewed) == len(touched):
            featured = engineer_features(recent)
        else:
            stored = of_campaigns(read_dataset(spark, store), touched)
            featured = refreshed_features(recent, stored, spans)
        featured = durable(featured)
        drop_campaigns(spark, store, renewed)
        write_dataset(featured, store, months=True)
        stored = of_campaigns(read_dataset(spark, store), touched)
        catalog_upsert(catalog_entries(stored, store, files), catalog)

    return (
        rows.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
