"""Raw text rows to clean daily facts, with an account of every repair."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adlens.functions.numbers import (
    as_bare_digits, as_number, as_signed, is_text, not_negative,
)
from adlens.functions.text import canonical_channel, na_to_null
from adlens.operators.spread import attach
from adlens.schema import KEYS, MEASURES, REQUIRED_COLUMNS
from adlens.session import durable

MODES = ("compat", "strict")

# Column metadata by which the audit knows of a renamed column.
_RENAMED = "renamed_from"

# The file of a row, where the reader tells it.
_PATH = "_path"

# A profile has one column per date format: the date as that format reads it.
_READING = "_day "


def normalize_header(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strip and title-case column names; ``Platform`` stands in for a missing ``Channel``."""
    names = [
        c if c in keys or c.startswith("_") else c.removeprefix("\ufeff").strip().title()
        for c in df.columns
    ]
    renamed = "Platform" in names and "Channel" not in names
    if renamed:
        names[names.index("Platform")] = "Channel"
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Column names occur more than once: {', '.join(twice)}")
    named = df.toDF(*names)
    return named.withMetadata("Channel", {_RENAMED: "Platform"}) if renamed else named


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns are missing: {', '.join(missing)}")
    return df


def _shape(fmt: str) -> str | None:
    """Pattern of the texts a purely numeric format can read, None for other formats."""
    if re.search(r"[^yMdHms\W\d_]|M{3}|[\[\]'#]", fmt):
        return None
    runs = re.findall(r"([A-Za-z])\1*|(.)", fmt)
    return "^" + "".join(r"[+-]?\d+" if letter else re.escape(other) for letter, other in runs) + "$"


def _read_date(token: Column, fmt: str) -> Column:
    """The text under one format; a cheap look at its shape spares a failing parse per row."""
    read = F.try_to_timestamp(token, F.lit(fmt))
    shape = _shape(fmt)
    return read if shape is None else F.when(token.rlike(shape), read)


def _at_grain(found: Column, grain: str) -> Column:
    if grain == "timestamp":
        return found
    if grain != "day":
        raise ValueError("grain is 'day' or 'timestamp'")
    return found.cast("date")


def parse_date(raw: Column, formats: Sequence[str] = ("yyyy-M-d",), grain: str = "day") -> Column:
    """Date of a text by the first format that fits, null if none does.

    This decides row by row; ``profile`` and ``clean`` choose one format per campaign.
    ``grain="timestamp"`` keeps the time of day.
    """
    token = na_to_null(raw)
    return _at_grain(F.coalesce(*[_read_date(token, f) for f in formats]), grain)


def parse_dates(
    df: DataFrame, formats: Sequence[str] = ("yyyy-M-d",), grain: str = "day"
) -> DataFrame:
    """Typed ``Date``; rows without a readable date are dropped."""
    return df.withColumn("Date", parse_date(F.col("Date"), formats, grain)).where(
        F.col("Date").isNotNull()
    )


def text_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per campaign and measure: does the file column hold a text that is not a number?

    Taken over all rows, also those whose date is bad, since it is a property of the file.
    """
    return df.groupBy(*keys).agg(
        *[F.max(is_text(F.col(c))).alias(f"_text_{c}") for c in MEASURES]
    )


def clean_numeric(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    mode: str = "compat",
    typed_by: DataFrame | None = None,
) -> DataFrame:
    """Measures as non-negative doubles, missing ones 0.0.

    ``compat``: in a file column with any text that is not a number, all but digits and dots is
    removed from every value (a minus sign too); other columns are read as they are.
    ``strict``: currency signs and separators are removed and the sign is kept.
    ``typed_by``: the rows that decide which columns are text, when ``df`` has lost some of them.

    The answers of a batch are stored on the way (``session.durable``): a row per campaign of known
    size, so the rows stay where they are instead of meeting all in the task of their campaign.
    """
    if mode == "strict":
        return df.withColumns(
            {c: not_negative(F.coalesce(as_signed(F.col(c)), F.lit(0.0))) for c in MEASURES}
        )
    if mode != "compat":
        raise ValueError(f"mode is one of {MODES}")
    flags = text_columns(df if typed_by is None else typed_by, keys)
    flags = flags if flags.isStreaming else durable(flags)
    flagged = attach(df, flags, keys, by=["Channel", *MEASURES]).withColumns(
        {f"_plain_{c}": as_number(F.col(c)) for c in MEASURES}
    )
    read = {}
    for c in MEASURES:
        number = F.col(f"_plain_{c}")
        bare = as_bare_digits(F.col(c))
        value = F.when(F.col(f"_text_{c}"), bare).otherwise(number)
        read[c] = not_negative(F.coalesce(value, F.lit(0.0)))
    return flagged.withColumns(read).drop(
        *[f"_{kind}_{c}" for c in MEASURES for kind in ("text", "plain")]
    )


def duplicate_count(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows beyond the first of each (Date, Channel), per campaign."""
    per_day = df.groupBy(*keys, "Date", "Channel").agg(F.count("*").alias("_n"))
    return per_day.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def merge_duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (Date, Channel): the five measures summed, other columns dropped."""
    return df.groupBy(*keys, "Date", "Channel").agg(*[F.sum(c).alias(c) for c in MEASURES])


def _typed(
    raw: DataFrame, keys: Sequence[str], formats: Sequence[str], grain: str, mode: str
) -> DataFrame:
    """Date by every format, channel and both readings of every measure, row by row."""
    plain = as_number if mode == "compat" else as_signed
    token = na_to_null(F.col("Date"))
    return raw.select(
        *keys,
        *[_at_grain(_read_date(token, f), grain).alias(_READING + f) for f in formats],
        canonical_channel(F.col("Channel")).alias("Channel"),
        *[c for c in raw.columns if c == _PATH],
        *MEASURES,
        *[plain(F.col(c)).alias(f"_plain_{c}") for c in MEASURES],
    ).withColumns(
        {
            name: value
            for c in MEASURES
            for name, value in (
                (f"_bare_{c}", as_bare_digits(F.col(c))),
                (f"_text_{c}", is_text(F.col(c), F.col(f"_plain_{c}"))),
            )
        }
    )


def _readings(profiled: DataFrame) -> dict[str, Column]:
    """The date columns of a profile by format, in the order of preference."""
    return {
        c.removeprefix(_READING): F.col(f"`{c}`")
        for c in profiled.columns
        if c.startswith(_READING)
    }


def _by_day(typed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both readings of every measure, summed and counted per (readings of the date, Channel)."""
    parts = [F.count("*").alias("_rows")]
    for c in MEASURES:
        number, bare = F.col(f"_plain_{c}"), F.col(f"_bare_{c}")
        parts += [
            F.sum(not_negative(F.coalesce(number, F.lit(0.0)))).alias(f"_plain_{c}"),
            F.sum(F.coalesce(bare, F.lit(0.0))).alias(f"_bare_{c}"),
            F.count_if(number.isNull()).alias(f"_plain_nulls_{c}"),
            F.count_if(bare.isNull()).alias(f"_bare_nulls_{c}"),
            F.count_if(number < 0).alias(f"_negatives_{c}"),
            F.max(f"_text_{c}").alias(f"_text_{c}"),
        ]
    if _PATH in typed.columns:
        parts += [F.min(_PATH).alias("_path_low"), F.max(_PATH).alias("_path_high")]
    return typed.groupBy(*keys, *_readings(typed).values(), "Channel").agg(*parts)


def profile(
    raw: DataFrame,
    keys: Sequence[str] = KEYS,
    formats: Sequence[str] = ("yyyy-M-d",),
    grain: str = "day",
    mode: str = "compat",
    observation: Observation | None = None,
) -> DataFrame:
    """Raw text rows as one row per (campaign, date, channel) with all that cleaning needs.

    Which reading of a number counts, and which format the dates have, is known only when the whole
    file has been seen. Summing every reading lets the choice wait until the rows are merged, so
    the raw rows are shuffled once, after partial sums, and never joined. There is one date column
    per format, null where it does not fit.
    """
    require_columns(raw)
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if not formats or len(set(formats)) < len(formats):
        raise ValueError("formats are one or more different date formats")
    typed = _typed(raw, keys, formats, grain, mode)
    if observation is not None:
        typed = typed.observe(observation, *_observed(list(_readings(typed).values())))
    return _by_day(typed, keys)


def file_traits(profiled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per campaign: its text columns, and the rows each date format reads.

    ``_format`` is the format that reads most rows, the first one in the order of preference if
    several read as many (``"1/2/2024"`` alone fits two).
    """
    readings = _readings(profiled)
    counts = F.array(
        *[
            F.sum(F.when(day.isNotNull(), F.col("_rows")).otherwise(0))
            for day in readings.values()
        ]
    )
    found = profiled.groupBy(*keys).agg(*_any_text(), counts.alias("_read"))
    return found.withColumn("_format", _chosen())


def _any_text() -> list[Column]:
    return [F.max(f"_text_{c}").alias(f"_text_{c}") for c in MEASURES]


def _chosen() -> Column:
    return F.array_position("_read", F.array_max("_read")).cast("int")


def merge_traits(
    traits: DataFrame, n_formats: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``file_traits`` of all parts of a campaign from those of each part.

    Counts are added and the format is chosen anew, so the order in which parts came never shows.
    """
    counts = F.array(*[F.sum(F.get("_read", F.lit(i))) for i in range(n_formats)])
    merged = traits.groupBy(*keys).agg(*_any_text(), counts.alias("_read"))
    return merged.withColumn("_format", _chosen())


def files_of_profile(profiled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One file of each campaign as ``filename``, and whether its rows come from ``several``."""
    low, high = F.min("_path_low"), F.max("_path_high")
    name = F.url_decode(F.replace(F.substring_index(low, "/", -1), F.lit("+"), F.lit("%2B")))
    return profiled.groupBy(*keys).agg(name.alias("filename"), (low < high).alias("several"))


def _dated(
    profiled: DataFrame,
    keys: Sequence[str],
    campaigns: int | None,
    traits: bool,
    known: DataFrame | None = None,
) -> DataFrame:
    """``Date`` of each profile row under its campaign's format, with the campaign's text columns
    if ``traits`` is set or the format has to be chosen. ``known`` are traits decided elsewhere."""
    readings = list(_readings(profiled).values())
    if len(readings) == 1 and not traits:
        return profiled.withColumn("Date", readings[0])
    own = profiled.drop(*[f"_text_{c}" for c in MEASURES])
    decided = file_traits(profiled, keys) if known is None else known
    placed = attach(own, decided, keys, by=["Channel"], known_rows=campaigns)
    return placed.withColumn("Date", F.get(F.array(*readings), F.col("_format") - 1))


def facts_of_profile(
    profiled: DataFrame,
    keys: Sequence[str] = KEYS,
    mode: str = "compat",
    campaigns: int | None = None,
    traits: DataFrame | None = None,
) -> DataFrame:
    """Clean facts of a (stored) profile.

    ``campaigns``: an upper bound of their number if it is known, such as the number of files.
    ``traits``: those of the whole campaigns, where ``profiled`` holds the parts of several batches;
    the parts meet by (Date, Channel). With a column ``since`` they leave out the days before it.
    """
    days = _dated(profiled, keys, campaigns, mode == "compat", traits).where("Date IS NOT NULL")
    if traits is not None and "since" in traits.columns:
        days = days.where("since IS NULL OR Date >= since")
    read = {c: F.col(f"_plain_{c}") for c in MEASURES}
    if mode == "compat":
        read = {c: F.when(F.col(f"_text_{c}"), F.col(f"_bare_{c}")).otherwise(read[c]) for c in read}
    facts = days.select(*keys, "Date", "Channel", *[read[c].alias(c) for c in MEASURES])
    # Rows that only another format tells apart meet under the chosen one.
    several = traits is not None or len(_readings(profiled)) > 1
    return merge_duplicates(facts, keys) if several else facts


def first_days(
    profiled: DataFrame, traits: DataFrame, keys: Sequence[str] = KEYS, campaigns: int | None = None
) -> DataFrame:
    """(campaign, first): the first day a profile has rows of under the decided formats, null if none."""
    days = _dated(profiled, keys, campaigns, True, traits)
    return days.groupBy(*keys).agg(F.min("Date").cast("date").alias("first"))


def clean(
    raw: DataFrame,
    keys: Sequence[str] = KEYS,
    formats: Sequence[str] = ("yyyy-M-d",),
    grain: str = "day",
    mode: str = "compat",
    observation: Observation | None = None,
    campaigns: int | None = None,
) -> DataFrame:
    """Clean facts, one row per (campaign, Date, Channel), from raw text rows.

    The dates of a campaign are read by the one of ``formats`` that reads most of its rows. The
    profile is stored on the way (``session.durable``), so the raw rows are read once.
    ``observation`` collects the counts of the repairs meanwhile, over all campaigns together;
    ``observed_repairs`` reads them. ``campaigns``: an upper bound of their number if it is known.
    """
    profiled = durable(profile(raw, keys, formats, grain, mode, observation))
    return facts_of_profile(profiled, keys, mode, campaigns)


def _observed(readings: Sequence[Column]) -> list[Column]:
    counts = [F.count("*").alias("loaded"), F.max(F.lit(len(readings))).alias("formats")]
    counts += [F.max(f"_text_{c}").alias(f"text_{c}") for c in MEASURES]
    for i, date in enumerate(readings):
        dated = date.isNotNull()
        counts.append(F.count_if(dated).alias(f"read_{i}"))
        for c in MEASURES:
            number, bare = F.col(f"_plain_{c}"), F.col(f"_bare_{c}")
            counts += [
                F.count_if(dated & number.isNull()).alias(f"plain_nulls_{c}_{i}"),
                F.count_if(dated & bare.isNull()).alias(f"bare_nulls_{c}_{i}"),
                F.count_if(dated & (number < 0)).alias(f"negatives_{c}_{i}"),
            ]
    return counts


def observed_repairs(observation: Observation, mode: str = "compat") -> dict[tuple[str, str], int]:
    """Counts by (step, column) of the observation passed to ``clean``, under the date format that
    reads most rows; meant for the rows of one campaign."""
    seen = observation.get
    best = max(range(seen["formats"]), key=lambda i: seen[f"read_{i}"])
    bad = seen["loaded"] - seen[f"read_{best}"]
    counts = {("loaded", ""): seen["loaded"], ("bad_date", "Date"): bad}
    for c in MEASURES:
        as_text = mode == "compat" and bool(seen[f"text_{c}"])
        kind = "bare_nulls" if as_text else "plain_nulls"
        counts[("null", c)] = seen[f"{kind}_{c}_{best}"]
        counts[("negative", c)] = 0 if as_text else seen[f"negatives_{c}_{best}"]
    return counts


def cleaning_audit(
    raw: DataFrame,
    keys: Sequence[str] = KEYS,
    formats: Sequence[str] = ("yyyy-M-d",),
    grain: str = "day",
    mode: str = "compat",
) -> DataFrame:
    """What ``clean`` repaired, as (campaign, step, column, n_rows), from one pass over the rows."""
    profiled = durable(profile(raw, keys, formats, grain, mode))
    return audit_of_profile(profiled, keys, mode, renamed_from(raw))


def renamed_from(raw: DataFrame) -> str | None:
    """The name the channel column had in the file, if ``normalize_header`` renamed it."""
    return raw.schema["Channel"].metadata.get(_RENAMED)


def _entry(step: str, column: str | Column, n_rows: Column) -> Column:
    named = F.lit(column) if isinstance(column, str) else column
    return F.struct(F.lit(step).alias("step"), named.alias("column"), n_rows.alias("n_rows"))


def date_audit_of_profile(profiled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How the dates of each campaign were read, as (campaign, step, column, n_rows).

    Step date_format: the chosen format and the rows it reads. Step date_tie: another format that
    reads as many, so that only the order of preference decided.
    """
    formats, most = list(_readings(profiled)), F.array_max("_read")
    names = F.array(*map(F.lit, formats))
    entries = [_entry("date_format", F.get(names, F.col("_format") - 1), most)]
    for i, name in enumerate(formats):
        tied = (most > 0) & (F.col("_format") != i + 1) & (F.get("_read", F.lit(i)) == most)
        entries.append(F.when(tied, _entry("date_tie", name, F.get("_read", F.lit(i)))))
    return file_traits(profiled, keys).select(*keys, F.inline(F.array_compact(F.array(*entries))))


def audit_of_profile(
    profiled: DataFrame,
    keys: Sequence[str] = KEYS,
    mode: str = "compat",
    renamed: str | None = None,
) -> DataFrame:
    """The audit of a (stored) profile as (campaign, step, column, n_rows).

    Null and negative counts are those of the rows that keep a date; which columns are text is
    decided by all rows. Steps: loaded, renamed (if a column was), bad_date, null, negative,
    duplicate, final.
    """
    dated = F.col("Date").isNotNull()
    counted = ["_rows"] + [
        f"_{kind}_{c}" for c in MEASURES for kind in ("plain_nulls", "bare_nulls", "negatives")
    ]
    texts = [f"_text_{c}" for c in MEASURES]
    days = _dated(profiled, keys, None, traits=False)
    if len(_readings(profiled)) > 1:
        # Rows that only another format tells apart meet under the chosen one.
        days = days.groupBy(*keys, "Date", "Channel", *texts).agg(*[F.sum(n).alias(n) for n in counted])
    counts = days.groupBy(*keys).agg(
        F.sum("_rows").alias("loaded"),
        F.sum(F.when(~dated, F.col("_rows")).otherwise(0)).alias("bad_date"),
        F.sum(F.when(dated, F.col("_rows") - 1).otherwise(0)).alias("duplicate"),
        F.count_if(dated).alias("final"),
        *[F.max(c).alias(c) for c in texts],
        *[F.sum(F.when(dated, F.col(n)).otherwise(0)).alias(n) for n in counted[1:]],
    )

    entries = [_entry("loaded", "", F.col("loaded"))]
    entries += [
        _entry(s, c, F.col(s)) for s, c in (("bad_date", "Date"), ("duplicate", ""), ("final", ""))
    ]
    if renamed:
        entries.append(_entry("renamed", renamed, F.col("loaded")))
    for c in MEASURES:
        as_text = F.col(f"_text_{c}") if mode == "compat" else F.lit(False)
        nulls = F.when(as_text, F.col(f"_bare_nulls_{c}")).otherwise(F.col(f"_plain_nulls_{c}"))
        negatives = F.when(as_text, F.lit(0)).otherwise(F.col(f"_negatives_{c}"))
        entries += [_entry("null", c, nulls), _entry("negative", c, negatives)]
    return counts.select(*keys, F.inline(F.array(*entries)))
