"""Joins and running totals in which no task holds all rows of one campaign.

A campaign may own a third of all rows. Aggregates cope by themselves (partial sums before the
shuffle); a join back on the campaign, or an order over all its channels, does not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import durable

# Parts of a hot key where adaptive execution may not split it.
SALTS = 16

# Buckets of a key whose rows are put in order, before equal values are cut further.
CUTS = 256

# A table known to have at most this many rows of a few numbers each is broadcast at once.
BROADCAST_ROWS = 100_000


def _salts(df: DataFrame) -> int:
    """One part when adaptive execution splits skewed joins by itself, ``SALTS`` otherwise.

    Streams are planned without it.
    """
    if df.isStreaming:
        return SALTS
    conf = df.sparkSession.conf
    adaptive = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return 1 if all(conf.get(name, "true") == "true" for name in adaptive) else SALTS


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    how: str = "left",
    salts: int | None = None,
    known_rows: int | None = None,
) -> DataFrame:
    """Join a table with one row per key (or a few) to ``rows``, whatever the size of a key.

    A caller that knows the number of rows of ``per_key`` without a job (one per input file, say)
    gives it as ``known_rows``: up to ``BROADCAST_ROWS`` the table is broadcast and ``rows`` stay
    where they are. Otherwise no broadcast is forced: ``per_key`` is broadcast when its known or
    measured size allows, and if not, adaptive execution cuts the partition of a hot key into as
    many tasks as it needs. For that both inputs must come straight from a shuffle, which an
    aggregate on the same keys does not; the part number in the join keys puts a shuffle there.
    With several ``salts`` a key is also cut by a hash of the ``by`` columns, each part with its
    own copy of the key's row.
    """
    if known_rows is not None and known_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_key), list(keys), how)
    salts = _salts(rows) if salts is None else salts
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return parts.join(copies, [*keys, "_part"], how).drop("_part")


def value_bucket(value: Column) -> Column:
    """Whole number that grows with the value: 16 buckets per doubling, 0 for zero.

    Doubles span about 2,100 doublings on each side, so a key has at most some 68,000 buckets.
    """
    steps = F.floor(F.log2(F.abs(value)) * 16) + 20000
    return (
        F.when(value > 0, steps).when(value < 0, -steps).otherwise(F.lit(0)).cast("int")
    )


def tie_hash(tie: str) -> Column:
    """The order among equal values: a hash of their names, which also spreads them evenly."""
    return F.md5(F.col(tie))


def cut_evenly(
    rows: DataFrame, keys: Sequence[str], value: str, tie: str, cuts: int = CUTS
) -> DataFrame:
    """``rows`` with the buckets ``_bucket`` and ``_tie`` for ``running_totals``, about equally full.

    The cut points of a key are quantiles of its own values, so a narrow range is cut as finely as a
    wide one. A value that is a cut point has a bucket to itself, which is cut further by
    ``tie_hash``: the order inside must be by value descending, then by ``tie_hash``. The quantiles
    are approximate and may differ between two runs, so they are stored once and both passes over
    the rows see the same; they decide about buckets only, never about positions or sums.
    """
    shares = F.expr("array(" + ", ".join(f"{i / cuts!r}D" for i in range(1, cuts)) + ")")
    points = durable(
        rows.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx(value, shares, 50 * cuts)).alias("_points")
        )
    )
    below = F.size(F.filter("_points", lambda point: point < F.col(value)))
    alone = F.array_contains("_points", F.col(value))
    part = F.conv(F.substring(tie_hash(tie), 1, 2), 16, 10).cast("int")
    return (
        attach(rows, points, keys, by=[tie])
        .withColumns(
            {
                "_bucket": F.coalesce(below * 2 + F.when(alone, 1).otherwise(0), F.lit(0)),
                "_tie": F.when(alone, -part).otherwise(0),
            }
        )
        .drop("_points")
    )


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: Mapping[str, Column],
    order: Sequence[Column],
    position: str,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Position and running sums of ``rows`` within each key, from the highest bucket down.

    Two levels instead of one window over the whole key: rows are numbered and summed inside
    their bucket, and the bucket's start comes from the totals of the buckets before it, a table
    as small as the number of buckets. ``bucket`` maps new column names to expressions that are
    compared descending before ``order``.
    """
    names = list(bucket)
    cut = rows.withColumns(dict(bucket))
    totals = cut.groupBy(*keys, *names).agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(*[F.desc(n) for n in names])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *keys,
        *names,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        *[
            F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0.0)).alias(f"_start_{n}")
            for n in sums
        ],
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut.withColumns(
        {
            position: F.row_number().over(inside).cast("bigint"),
            **{n: F.sum(c).over(so_far) for n, c in sums.items()},
        }
    )
    placed = numbered.join(starts, [*keys, *names])
    return placed.withColumns(
        {
            position: F.col(position) + F.col("_start"),
            **{n: F.col(n) + F.col(f"_start_{n}") for n in sums},
        }
    ).drop(*names, "_start", *[f"_start_{n}" for n in sums])
