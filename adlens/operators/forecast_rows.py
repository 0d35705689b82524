"""Forest forecasts of channels with many rows a day.

The features of a row are those of its day, so a forest over rows needs of each day and tree only
how many rows the tree drew and the sums over them. Spark draws and sums them, one very large
channel in as many tasks as its rows need; the trees are then grown on a table bounded by the
calendar, and are those that growing on all drawn rows would give.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.calendar import holiday_flag
from adlens.operators import forest
from adlens.operators.features import with_model_features
from adlens.operators.forecast import (
    _MODEL_INPUTS, _check_horizon, forecast_flat, history_as_forecast, prediction_bounds,
)
from adlens.schema import (
    CONFIDENCE, FOREST_DEPTH, FOREST_SEED, FOREST_TREES, HOLIDAYS, HORIZON_DAYS, KEYS, MEASURES,
    MIN_FOREST_ROWS,
)

#: Shares of rows drawn at most 0, 1, 2 ... times (Poisson with mean one).
_SHARES = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))

#: The tree that draws every row once.
ALL_ROWS = -1


def row_draws(
    df: DataFrame, keys: Sequence[str] = KEYS, n_trees: int = FOREST_TREES, seed: int = FOREST_SEED
) -> DataFrame:
    """Each row with ``_tree`` and ``_draws`` for each tree that draws it, and once for ``ALL_ROWS``.

    Draws follow a hash of campaign, channel and time, so they are the same on every run and rows
    are drawn where they lie. Rows that repeat a time are drawn together.
    """
    share = F.pmod(F.xxhash64(*keys, "Channel", "Date", "_tree", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    draws = sum((F.when(share >= s, 1).otherwise(0) for s in _SHARES), F.lit(0))
    drawn = df.withColumn("_tree", F.explode(F.sequence(F.lit(ALL_ROWS), F.lit(n_trees - 1))))
    return drawn.withColumn("_draws", F.when(F.col("_tree") == ALL_ROWS, 1).otherwise(draws)).where("_draws > 0")


def daily_draws(
    df: DataFrame, keys: Sequence[str] = KEYS, n_trees: int = FOREST_TREES, seed: int = FOREST_SEED
) -> DataFrame:
    """Rows drawn and sums over them per channel, day and tree.

    Sums are decimals of six digits, so they do not depend on the order of rows; a missing measure
    counts as zero.
    """
    rows = df.select(*keys, "Channel", "Date", *MEASURES)
    sums = [F.sum((F.col(c) * F.col("_draws")).cast("decimal(28,6)")).cast("double").alias(c) for c in MEASURES]
    return row_draws(rows, keys, n_trees, seed).groupBy(
        *keys, "Channel", F.col("Date").cast("date").alias("Date"), "_tree"
    ).agg(F.sum("_draws").cast("double").alias("_drawn"), *[F.coalesce(s, F.lit(0.0)).alias(c) for s, c in zip(sums, MEASURES)])


def forest_stats_of_rows(
    df: DataFrame,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] = KEYS,
    n_trees: int = FOREST_TREES,
    max_depth: int = FOREST_DEPTH,
    seed: int = FOREST_SEED,
    min_rows: int = MIN_FOREST_ROWS,
) -> DataFrame:
    """Per channel and future date, mean and spread of the tree predictions for each target.

    For channels with at least ``min_rows`` rows with a date. A tree that drew no row takes all.
    """
    _check_horizon(horizon)
    ids = [*keys, "Channel"]
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    of_all = F.sum(F.when(F.col("_tree") == ALL_ROWS, F.col("_drawn"))).over(Window.partitionBy(*ids))
    days = daily_draws(df.where("Date IS NOT NULL"), keys, n_trees, seed).withColumn("HolidayFlag", holiday_flag(F.col("Date")))
    cells = (
        with_model_features(days)
        .select(*ids, "_tree", "_drawn", *_MODEL_INPUTS, *MEASURES)
        .repartition(parts, *ids)
        .withColumn("_rows", of_all).where(F.col("_rows") >= min_rows).drop("_rows")
    )
    inputs, targets, every = _MODEL_INPUTS, MEASURES, ALL_ROWS
    holidays = frozenset(divmod(month_day, 100) for month_day in HOLIDAYS)
    grow, predict, ahead = forest.grow, forest.predict, forest.future_points
    schema = T.StructType([
        *[df.schema[c] for c in ids], T.StructField("Date", T.DateType()),
        *[T.StructField(f"{c}_{what}", T.DoubleType()) for c in MEASURES for what in ("mean", "std")],
    ])

    def of_series(table: pa.Table) -> pa.Table:
        known = np.column_stack([table.column(c).to_numpy() for c in inputs])
        _, first, day = np.unique(known[:, 0], return_index=True, return_inverse=True)
        features = known[first]
        place = (table.column("_tree").to_numpy() - every, day)  # all rows come first
        counts = np.zeros((n_trees + 1, len(first)))
        sums = np.zeros((n_trees + 1, len(first), len(targets)))
        counts[place] = table.column("_drawn").to_numpy()
        sums[place] = np.column_stack([table.column(c).to_numpy() for c in targets])
        idle = counts.sum(axis=1) == 0
        counts[idle], sums[idle] = counts[0], sums[0]
        dates, future = ahead(int(features[-1, 0]), horizon, holidays)
        out = {c: pa.repeat(table.column(c)[0], horizon) for c in ids}
        out["Date"] = pa.array(dates, pa.date32())
        for i, target in enumerate(targets):
            trees = predict(grow(features, sums[1:, :, [i]], counts[1:], max_depth, seed), future, n_trees)
            out[f"{target}_mean"], out[f"{target}_std"] = trees.mean(axis=0), trees.std(axis=0)
        return pa.table(out)

    return cells.groupBy(*ids).applyInArrow(of_series, schema)


def forecast_rows(
    featured: DataFrame,
    horizon: int = HORIZON_DAYS,
    level: float = CONFIDENCE,
    keys: Sequence[str] = KEYS,
    **forest_options,
) -> DataFrame:
    """History and forecast of every channel in one table, whatever its rows a day.

    Forecast rows are days; history keeps one row per row given. Of the rows of a short channel the
    last in time is carried forward.
    """
    stats = forest_stats_of_rows(featured, horizon, keys, **forest_options)
    return (
        history_as_forecast(featured, keys)
        .unionByName(forecast_flat(featured, horizon, keys))
        .unionByName(prediction_bounds(stats, level, keys))
    )
