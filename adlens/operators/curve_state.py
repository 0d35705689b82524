"""Response curves kept up to date by day, without a second look at unchanged days.

Every sum behind a curve is additive over days. The state is a log of differences per channel: a
changed day is taken out as it was and put in as it is, a new day is put in, a lost one taken out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators.response import ALPHAS, curve_of_sums
from adlens.schema import KEYS
from adlens.sources.batches import append_batch

_AVERAGED = ("Spend", "Revenue", "Conversions")


def _terms() -> dict[str, Column]:
    """What one day adds to the sums of its channel."""
    log_spend = F.log1p(F.col("Spend"))
    return {
        "days": F.lit(1).cast("bigint"),
        "squares": log_spend * log_spend,
        **{f"sum_{a}": F.col(y) * log_spend for a, y in ALPHAS.items()},
        **{f"sum_{c}": F.col(c) for c in _AVERAGED},
    }


def differences(
    new: DataFrame, old: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Change of the sums per channel when the days ``old`` become the days ``new``.

    Both hold the changed days only, one row per (campaign, Date, Channel) as cleaning leaves them.
    """
    terms = _terms()
    columns = [*keys, "Channel"]
    added = new.select(*columns, *[t.alias(n) for n, t in terms.items()])
    if old is not None:
        added = added.unionByName(old.select(*columns, *[(-t).alias(n) for n, t in terms.items()]))
    return added.groupBy(*columns).agg(*[F.sum(n).alias(n) for n in terms])


def update_state(
    new: DataFrame, old: DataFrame | None, path: str, batch_id: int
) -> None:
    """Log the differences of a batch; the same batch again replaces what it wrote before."""
    append_batch(differences(new, old), path, batch_id)


def read_state(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sums per channel; channels that have lost all their days are gone."""
    logged = spark.read.parquet(path)
    names = list(_terms())
    sums = logged.groupBy(*keys, "Channel").agg(*[F.sum(n).alias(n) for n in names])
    return sums.where("days > 0")


def fold_state(spark: SparkSession, path: str, into: str) -> None:
    """A log at ``into`` with one row per channel instead of one per channel and batch."""
    append_batch(read_state(spark, path), into, -1)


def curves_of_state(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``fit_curves`` of all days in the state."""
    averages = {f"avg_{c.lower()}": F.col(f"sum_{c}") / F.col("days") for c in _AVERAGED}
    return curve_of_sums(
        state, F.col("squares"), {a: F.col(f"sum_{a}") for a in ALPHAS}, averages, keys
    )
