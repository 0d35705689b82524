"""Channel forecasts: flat for short series, a forest per channel and target for the others.

The band is the disagreement of the trees, not a calibrated prediction interval. Trees do not
extrapolate: beyond the last date the calendar columns carry the pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.calendar import holiday_flag
from adlens.functions.numbers import mean_of, not_negative, ratio, spread_of, z_score
from adlens.operators import forest
from adlens.operators.features import with_model_features
from adlens.schema import (
    CONFIDENCE, FLAT_LOWER, FLAT_UPPER, FORECAST_COLUMNS, FOREST_DEPTH, FOREST_SEED,
    FOREST_TREES, HOLIDAYS, HORIZON_DAYS, KEYS, MEASURES, MIN_FOREST_ROWS,
)

# Workers get the tree code with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(forest)

_MODEL_INPUTS = ("Ordinal", "DayOfWeek", "DayOfMonth", "Month", "HolidayFlag")

# Rows x trees x targets of the series that grow together, so that their arrays fit the caches, and
# rows of the result that leave Python together.
_TREE_ROWS_AT_ONCE = 40_000
_ROWS_OUT = 10_000


def _check_horizon(horizon: int) -> int:
    if not isinstance(horizon, int) or isinstance(horizon, bool) or horizon < 1:
        raise ValueError("horizon is a whole number of days, at least 1")
    return horizon


def _dates_after(date: Column, horizon: int) -> Column:
    return F.explode(F.sequence(F.date_add(date, 1), F.date_add(date, horizon)))


def future_calendar(
    df: DataFrame, horizon: int = HORIZON_DAYS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The ``horizon`` dates after each channel's own last date."""
    _check_horizon(horizon)
    ends = df.groupBy(*keys, "Channel").agg(F.max("Date").cast("date").alias("_end"))
    return ends.select(*keys, "Channel", _dates_after(F.col("_end"), horizon).alias("Date"))


def forecast_flat(
    df: DataFrame,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] = KEYS,
    below: int | None = MIN_FOREST_ROWS,
) -> DataFrame:
    """Last row carried forward, +/-10 % bands, for channels with fewer than ``below`` rows.

    ``below=None`` takes every channel.
    """
    _check_horizon(horizon)
    kept = [*MEASURES, "ROAS"]
    series = df.groupBy(*keys, "Channel").agg(
        F.count("*").alias("_rows"),
        F.max("Date").cast("date").alias("_end"),
        *[F.max_by(c, "Date").alias(c) for c in kept],
    )
    if below is not None:
        series = series.where(F.col("_rows") < below)
    ahead = series.select(
        *keys,
        "Channel",
        _dates_after(F.col("_end"), horizon).alias("Date"),
        *kept,
    )
    bands = {
        f"{c}_{side}": F.col(c) * factor
        for c in ("Revenue", "Conversions")
        for side, factor in (("Lower", FLAT_LOWER), ("Upper", FLAT_UPPER))
    }
    return ahead.withColumns({**bands, "IsForecast": F.lit(True)}).select(*keys, *FORECAST_COLUMNS)


def _grow_per_series(
    df: DataFrame,
    keys: Sequence[str],
    min_rows: int,
    fields: Sequence[T.StructField],
    draws: forest.Draws,
    emit: Callable[[list, forest.Draws], tuple[dict, Sequence[int]]],
) -> DataFrame:
    """The rows that ``emit`` makes of the known rows of some series, each in order of date.

    ``emit`` gets features and targets of a few short series or of one long one, and returns columns
    and the number of rows of each series. Numpy then handles as many numbers per call as the caches
    hold, whatever the length of a series. Tasks read their rows in order of the series.

    Needs one row per (campaign, Channel, day), as cleaning leaves it. This is what bounds the rows
    of a call, so it is checked before any series reaches Python: one with more rows than its
    dates span fails the query. The seed is the same for every series, so results do not depend
    on partitioning.
    """
    session = df.sparkSession
    series = Window.partitionBy(*keys, "Channel")
    # An explicit count: the rows are few bytes but much work, and must not be coalesced.
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, session.sparkContext.defaultParallelism)
    ids = [*keys, "Channel"]
    count, day = F.count("*").over(series), F.col("Ordinal")
    span = F.max(day).over(series) - F.min(day).over(series) + 1
    wrong = F.raise_error(F.concat(F.lit("several rows per day in channel "), F.col("Channel")))
    rows = (
        with_model_features(df)
        .select(*ids, *_MODEL_INPUTS, *MEASURES)
        .repartition(parts, *ids)
        .withColumn("_rows", F.when(count > span, wrong.cast("bigint")).otherwise(count))
        .where(F.col("_rows") >= min_rows)
        .sortWithinPartitions(*ids)  # no second sort: it is the order the counts are made in
    )
    schema = T.StructType([*[df.schema[c] for c in ids], *fields])
    inputs, targets, at_once, rows_out = _MODEL_INPUTS, MEASURES, _TREE_ROWS_AT_ONCE, _ROWS_OUT
    tree_rows, fresh = draws.trees * len(MEASURES), forest.Draws

    def in_order(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_date = np.argsort(known[:, 0])
        return known[by_date], values[by_date]

    def grown(table: pa.Table, starts: list, made_by: forest.Draws):
        """What ``emit`` makes of the whole series of a table, which begin at ``starts``."""
        known = np.column_stack([table.column(c).to_numpy() for c in inputs])
        values = np.column_stack([table.column(c).to_numpy() for c in targets])
        first = 0
        while first < len(starts) - 1:
            last = first + 1
            while last < len(starts) - 1 and (starts[last + 1] - starts[first]) * tree_rows <= at_once:
                last += 1
            some = [in_order(known[a:b], values[a:b]) for a, b in zip(starts[first:last], starts[first + 1:last + 1])]
            made, lengths = emit(some, made_by)
            named = table.select(ids).take(np.repeat(starts[first:last], lengths))
            yield pa.table({**{c: named.column(c) for c in ids}, **made})
            first = last

    def of_rows(batches):
        made_by = fresh(draws.trees, draws.depth, draws.seed)
        rest, ready, n_ready = None, [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            lengths, starts = table.column("_rows").to_numpy(), [0]
            # A series has as many rows as each of its rows says; the last one may be cut off.
            while starts[-1] < len(lengths) and starts[-1] + lengths[starts[-1]] <= len(lengths):
                starts.append(starts[-1] + int(lengths[starts[-1]]))
            for made in grown(table.slice(0, starts[-1]), starts, made_by):
                ready.append(made)
                n_ready += len(made)
                if n_ready >= rows_out:
                    yield from pa.concat_tables(ready).combine_chunks().to_batches()
                    ready, n_ready = [], 0
            rest = table.slice(starts[-1])
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return rows.mapInArrow(of_rows, schema)


def _predict_per_series(
    df: DataFrame,
    horizon: int,
    keys: Sequence[str],
    n_trees: int,
    max_depth: int,
    seed: int,
    min_rows: int,
    fields: Sequence[T.StructField],
    emit: Callable[[str, np.ndarray], dict],
) -> DataFrame:
    """One row per future date with what ``emit`` makes of the predictions of the trees, of the
    shape (trees, future dates of all series)."""
    _check_horizon(horizon)
    holidays = frozenset(divmod(month_day, 100) for month_day in HOLIDAYS)
    targets, grow, ahead = MEASURES, forest.forests_of_many, forest.future_points

    def predictions(series: list, draws: forest.Draws) -> tuple[dict, list]:
        futures = [ahead(int(known[-1, 0]), horizon, holidays) for known, _ in series]
        dates = [date for days, _ in futures for date in days]
        out = {"Date": pa.array(dates, pa.date32())}
        for target, trees in zip(targets, grow(series, [points for _, points in futures], draws)):
            out.update(emit(target, trees))
        return out, [horizon] * len(series)

    dated = [T.StructField("Date", T.DateType()), *fields]
    draws = forest.Draws(n_trees, max_depth, seed)
    return _grow_per_series(df, keys, min_rows, dated, draws, predictions)


def forest_trees(
    df: DataFrame,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] = KEYS,
    n_trees: int = FOREST_TREES,
    max_depth: int = FOREST_DEPTH,
    seed: int = FOREST_SEED,
    min_rows: int = MIN_FOREST_ROWS,
) -> DataFrame:
    """Per channel and future date, one array with all tree predictions for each target.

    Arrays keep the trees of a date in one row: no shuffle is needed to take their mean.
    """
    fields = [T.StructField(f"{c}_trees", T.ArrayType(T.DoubleType())) for c in MEASURES]

    def emit(target: str, trees: np.ndarray) -> dict:
        ends = np.arange(trees.shape[1] + 1, dtype=np.int32) * trees.shape[0]
        flat = np.ascontiguousarray(trees.T).ravel()
        return {f"{target}_trees": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    return _predict_per_series(df, horizon, keys, n_trees, max_depth, seed, min_rows, fields, emit)


def forest_stats(
    df: DataFrame,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] = KEYS,
    n_trees: int = FOREST_TREES,
    max_depth: int = FOREST_DEPTH,
    seed: int = FOREST_SEED,
    min_rows: int = MIN_FOREST_ROWS,
) -> DataFrame:
    """Per channel and future date, mean and spread of the tree predictions for each target.

    The same as ``tree_stats(forest_trees(...))`` without handing the trees to the JVM.
    """
    fields = [
        T.StructField(f"{c}_{what}", T.DoubleType()) for c in MEASURES for what in ("mean", "std")
    ]

    def emit(target: str, trees: np.ndarray) -> dict:
        return {f"{target}_mean": pa.array(trees.mean(axis=0)),
                f"{target}_std": pa.array(trees.std(axis=0))}

    return _predict_per_series(df, horizon, keys, n_trees, max_depth, seed, min_rows, fields, emit)


def forest_nodes(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    n_trees: int = FOREST_TREES,
    max_depth: int = FOREST_DEPTH,
    seed: int = FOREST_SEED,
    min_rows: int = MIN_FOREST_ROWS,
) -> DataFrame:
    """The grown forests as a table to store: one row per (campaign, Channel, target, tree).

    The arrays ``feature``, ``threshold``, ``left`` and ``value`` hold the nodes of the tree, the root
    first. ``feature`` is a place in (Ordinal, DayOfWeek, DayOfMonth, Month, HolidayFlag), -1 in a
    leaf; a row goes to the node ``left`` where it is at or below the threshold, else to the next.
    """
    numbers, whole = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
    fields = [
        T.StructField(name, kind)
        for name, kind in (("target", T.StringType()), ("tree", T.IntegerType()), ("feature", whole),
                           ("threshold", numbers), ("left", whole), ("value", numbers))
    ]
    targets, grow, by_tree = MEASURES, forest.grow_several, forest.by_tree

    def trees(series: list, draws: forest.Draws) -> tuple[dict, list]:
        parts = []
        for i, nodes in enumerate(grow(series, draws)):
            nodes, starts = by_tree(nodes)
            number = nodes.tree[starts] + i * n_trees  # one table per target, or one of all series
            ends = pa.array(np.append(starts, len(nodes.tree)).astype(np.int32))

            def lists(column, kind):
                return pa.ListArray.from_arrays(ends, pa.array(column.astype(kind)))

            parts.append(pa.table({
                "target": pa.array(targets).take(number // n_trees % len(targets)),
                "tree": pa.array((number % n_trees).astype(np.int32)),
                "feature": lists(nodes.feature, np.int32),
                "threshold": lists(nodes.threshold, np.float64),
                "left": lists(nodes.left, np.int32),
                "value": lists(nodes.value, np.float64),
            }))
        made = pa.concat_tables(parts).combine_chunks()
        per_series = n_trees * len(targets)
        return {c: made.column(c) for c in made.column_names}, [per_series] * len(series)

    return _grow_per_series(df, keys, min_rows, fields, forest.Draws(n_trees, max_depth, seed), trees)


def score_nodes(
    nodes: DataFrame, days: DataFrame, keys: Sequence[str] = KEYS, max_depth: int = FOREST_DEPTH
) -> DataFrame:
    """``forest_stats`` of a stored node table for the rows of ``days`` (campaign, Channel, Date).

    Every tree is walked by expressions, without Python and without the history; ``days`` need not
    be the ones after the last date. The days of a channel meet its trees in one join, which keeps
    the days in memory and reads the much larger nodes past them unsorted. A step is a column of
    its own, so that it is compiled; ``aggregate`` would be interpreted for every day and tree.
    """
    ids = [*keys, "Channel"]
    point = F.array(*[F.col(c).cast("double") for c in _MODEL_INPUTS])
    points = (
        with_model_features(days.select(*ids, "Date"))
        .withColumn("HolidayFlag", holiday_flag(F.col("Date")))
        .select(*ids, "Date", point.alias("_point"))
    )
    at, place = F.col("_at"), F.get("feature", F.col("_at"))
    right = F.get("_point", place) > F.get("threshold", at)
    step = F.when(place < 0, at).otherwise(F.get("left", at) + right.cast("int"))
    walked = nodes.join(points.hint("shuffle_hash"), ids).withColumn("_at", F.lit(0))
    for _ in range(max_depth):
        walked = walked.withColumn("_at", step)
    of_target = walked.groupBy(*ids, "Date", "target").agg(
        F.avg(F.get("value", at)).alias("mean"), F.stddev_pop(F.get("value", at)).alias("std")
    )
    return of_target.groupBy(*ids, "Date").agg(
        *[
            F.max(F.when(F.col("target") == c, F.col(what))).alias(f"{c}_{what}")
            for c in MEASURES
            for what in ("mean", "std")
        ]
    )


def tree_stats(trees: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and population standard deviation of the tree arrays."""
    means = trees.withColumns({f"{c}_mean": mean_of(F.col(f"{c}_trees")) for c in MEASURES})
    return means.select(
        *keys,
        "Channel",
        "Date",
        *[F.col(f"{c}_mean") for c in MEASURES],
        *[
            spread_of(F.col(f"{c}_trees"), F.col(f"{c}_mean")).alias(f"{c}_std")
            for c in MEASURES
        ],
    )


def prediction_bounds(
    stats: DataFrame, level: float = CONFIDENCE, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Forecast rows of tree statistics: mean, band of z deviations, nothing below zero."""
    z = z_score(level)
    bands = {}
    for c in ("Revenue", "Conversions"):
        mean, width = F.col(f"{c}_mean"), z * F.col(f"{c}_std")
        bands[f"{c}_Lower"] = not_negative(mean - width)
        bands[f"{c}_Upper"] = not_negative(mean + width)
    points = stats.withColumns({c: not_negative(F.col(f"{c}_mean")) for c in MEASURES})
    return points.withColumns(
        {**bands, "ROAS": ratio(F.col("Revenue"), F.col("Spend")), "IsForecast": F.lit(True)}
    ).select(*keys, *FORECAST_COLUMNS)


def forecast_forest(
    df: DataFrame,
    horizon: int = HORIZON_DAYS,
    level: float = CONFIDENCE,
    keys: Sequence[str] = KEYS,
    **forest_options,
) -> DataFrame:
    """Forest forecast of the channels with enough rows."""
    return prediction_bounds(forest_stats(df, horizon, keys, **forest_options), level, keys)


def history_as_forecast(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Actual rows in forecast shape; the bands equal the actual values."""
    bands = {f"{c}_{side}": F.col(c) for c in ("Revenue", "Conversions")
             for side in ("Lower", "Upper")}
    return df.withColumns(
        {**bands, "Date": F.col("Date").cast("date"), "IsForecast": F.lit(False)}
    ).select(*keys, *FORECAST_COLUMNS)


def forecast(
    featured: DataFrame,
    horizon: int = HORIZON_DAYS,
    level: float = CONFIDENCE,
    keys: Sequence[str] = KEYS,
    **forest_options,
) -> DataFrame:
    """History and forecast of every channel in one table."""
    return (
        history_as_forecast(featured, keys)
        .unionByName(forecast_flat(featured, horizon, keys))
        .unionByName(forecast_forest(featured, horizon, level, keys, **forest_options))
    )


def forecast_all_flat(
    featured: DataFrame, horizon: int = HORIZON_DAYS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """History and the carry-forward forecast of every channel: no Python, for quick looks."""
    return history_as_forecast(featured, keys).unionByName(
        forecast_flat(featured, horizon, keys, below=None)
    )
