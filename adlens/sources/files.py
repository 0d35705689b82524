"""Campaign CSV files in, featured datasets out and in again."""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.formats import iso_date
from adlens.operators.cleaning import normalize_header, require_columns
from adlens.operators.spread import attach
from adlens.schema import FEATURED_SCHEMA, KEYS, PREVIEW_ROWS, REQUIRED_COLUMNS
from adlens.session import durable


def _check_extension(paths: Sequence[str]) -> None:
    for path in paths:
        extension = os.path.splitext(path.rstrip("/"))[1]
        if extension and extension.lower() != ".csv":
            raise ValueError(f"Only .csv files are read: {path}")


# Text columns the readers add to those of the file.
_CORRUPT, _PATH = "_corrupt", "_path"

# The month folders of a dataset.
_MONTH = "_month"


def _told(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.col(_CORRUPT))).cast("string")


def _open_quote(last: Column) -> Column:
    """A short row with an odd number of quotes: a quoted line break cut it in two."""
    quotes = F.length(_CORRUPT) - F.length(F.replace(_CORRUPT, F.lit('"'), F.lit("")))
    return F.col(_CORRUPT).isNotNull() & last.isNull() & (quotes % 2 == 1)


def identified(rows: DataFrame, last: str, too_long: Column, id_from: str = "name") -> DataFrame:
    """``campaign_id`` and ``_path`` of each row; rows that were not read whole fail the query.

    ``last`` is the last column of the header. ``id_from="path"`` takes the whole path, for folders
    in which several files have the same name.
    """
    path = F.url_decode(F.replace(_PATH, F.lit("+"), F.lit("%2B")))
    if id_from == "path":
        campaign = F.regexp_replace(path, r"(?i)^[a-z0-9]+:/*|\.csv$", "")
    elif id_from == "name":
        campaign = F.regexp_replace(path, r"(?i)^.*/|\.csv$", "")
    else:
        raise ValueError("id_from is 'name' or 'path'")
    whole = (
        F.when(too_long, _told("too many fields in row: "))
        .when(_open_quote(F.col(f"`{last}`")), _told("line break inside quotes, read with multi_line: "))
        .otherwise(campaign)
    )
    return rows.withColumn("campaign_id", whole).drop(_CORRUPT)


def read_campaign_csv(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, id_from: str = "name"
) -> DataFrame:
    """Campaign files as text columns under normalised names, ``campaign_id`` from the file name
    (or from the whole path with ``id_from="path"``).

    Files, folders and globs. No types are inferred: that would cost a pass and hide what was
    written. All files of a call share one header; a file with another one fails the read instead
    of being read by position (``read_campaign_layouts`` takes mixed headers). Short rows are
    filled with nulls, a row with more fields than the header fails the query, and so does a row
    that a line break inside quotes has cut. ``multi_line`` reads such rows; each file is then read
    by one task.
    """
    paths = [path] if isinstance(path, str) else list(path)
    _check_extension(paths)
    try:
        reader = spark.read.option("header", True).option("enforceSchema", False)
        reader = reader.option("pathGlobFilter", "*.csv").option("escape", '"')
        reader = reader.option("multiLine", multi_line)
        header = reader.csv(paths).schema
        whole = T.StructType([*header.fields, T.StructField(_CORRUPT, T.StringType())])
        raw = reader.option("columnNameOfCorruptRecord", _CORRUPT).schema(whole).csv(paths)
        raw = raw.select("*", F.col("_metadata.file_path").alias(_PATH))
    except AnalysisException as error:
        raise ValueError(f"Failed to read CSV: {error}") from error
    if not header.fields:
        raise ValueError("Failed to read CSV: no header")
    last = header.fields[-1].name
    too_long = F.col(_CORRUPT).isNotNull() & F.col(f"`{last}`").isNotNull()
    return require_columns(normalize_header(identified(raw, last, too_long, id_from)))


def read_campaign_layouts(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, id_from: str = "name"
) -> DataFrame:
    """Campaign files whose headers differ, as the required columns.

    One distributed pass finds the header of every file; only the different headers reach the
    driver. The files are then read once, by position, and each row takes its columns from the
    places its file's header gives them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    _check_extension(paths)
    try:
        lines = spark.read.option("pathGlobFilter", "*.csv").text(paths)
    except AnalysisException as error:
        raise ValueError(f"Failed to read CSV: {error}") from error
    starts = (
        lines.select("value", F.col("_metadata.file_path").alias(_PATH),
                     F.col("_metadata.file_block_start").alias("block"))
        .where((F.col("block") == 0) & (F.trim("value") != ""))
        .withColumn("at", F.monotonically_increasing_id())
    )
    heads = durable(
        starts.groupBy(_PATH).agg(F.regexp_replace(F.min_by("value", "at"), "\r$", "").alias("_head"))
    )
    texts = sorted(row[0] for row in heads.select("_head").distinct().collect())
    if not texts:
        raise ValueError("Failed to read CSV: no files")
    layouts = {}
    for text in texts:
        names = next(csv.reader([text.removeprefix("\ufeff")]))
        empty = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
        layouts[text] = require_columns(normalize_header(empty)).columns
    width = max(map(len, layouts.values()))
    # One place more than the widest header, so that a row too long for it shows.
    places = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width + 1)])
    raw = (
        spark.read.option("header", True).option("enforceSchema", True)
        .option("pathGlobFilter", "*.csv").option("escape", '"').option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(T.StructType([*places.fields, T.StructField(_CORRUPT, T.StringType())]))
        .csv(paths)
        .select("*", F.col("_metadata.file_path").alias(_PATH))
    )
    rows = attach(raw, heads, [_PATH], by=["_0", "_1"])

    def of_layout(place) -> Column:
        cases = [F.when(F.col("_head") == t, F.col(f"_{place(c)}")) for t, c in layouts.items()]
        return F.coalesce(*cases)

    named = rows.select(
        _PATH, _CORRUPT,
        *[of_layout(lambda names, c=c: names.index(c)).alias(c) for c in REQUIRED_COLUMNS],
        of_layout(lambda names: len(names) - 1).alias("_last"),
        of_layout(len).alias("_beyond"),
    )
    found = identified(named, "_last", F.col("_beyond").isNotNull(), id_from)
    return found.drop("_last", "_beyond")


def write_dataset(
    df: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = KEYS,
    months: bool = False,
) -> None:
    """Store featured rows by campaign; the campaigns written are replaced, others stay.

    Rebalancing gathers small campaigns and lets adaptive execution cut a campaign that is too
    large for one task. Rows are ordered by date inside the files. ``months``: a campaign has a
    folder per month of ``Date``, and only the months written are replaced (``drop_campaigns``
    removes the others).
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt is 'parquet' or 'csv'")
    folders = [*keys, _MONTH] if months else list(keys)
    placed = df.withColumn(_MONTH, F.date_format("Date", "yyyy-MM")) if months else df
    ordered = placed.hint("rebalance", *[F.col(k) for k in folders]).sortWithinPartitions(
        *folders, "Date", "Channel"
    )
    writer = ordered.write.mode("overwrite").partitionBy(*folders)
    writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_dataset(
    spark: SparkSession, path: str, campaign_id: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Stored rows, typed; of one campaign when named (only its folder is read)."""
    reader = spark.read.schema(FEATURED_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    try:
        stored = reader.load(path)
    except AnalysisException as error:
        raise LookupError(f"No dataset at {path}") from error
    stored = stored.select(*FEATURED_SCHEMA.names)  # without the months of the folders
    if campaign_id is None:
        return stored
    found = stored.where(F.col("campaign_id") == campaign_id)
    if found.isEmpty():
        raise LookupError(f"Campaign {campaign_id} not found at {path}")
    return found


def drop_campaigns(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """Remove the folders of the named campaigns, a list on the driver of a bounded number."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/campaign_id={escape(name)}")
        folder.getFileSystem(conf).delete(folder, True)


def of_campaigns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named campaigns; a filter, so that only their folders are read.

    The names are a list on the driver, which a caller holds only of a bounded number of campaigns.
    """
    return df.where(F.col("campaign_id").isin(list(names)))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """First ``n`` rows of each campaign by date, dates as ISO text."""
    first = Window.partitionBy(*keys).orderBy("Date", "Channel")
    return (
        df.withColumn("_row", F.row_number().over(first))
        .where(F.col("_row") <= n)
        .drop("_row")
        .transform(to_records)
    )


def to_records(df: DataFrame) -> DataFrame:
    """Rows with ISO dates, ready for a JSON or text output."""
    return df.withColumn("Date", iso_date(F.col("Date")))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row with ISO dates."""
    return to_records(df).select(F.to_json(F.struct("*")).alias("value"))
