"""Exact dedup by heavy-hitter split, DataFrame functions only.

A Misra-Gries style summary (``approx_top_k``, a mergeable frequent-items sketch of fixed size)
names the digests that may be frequent. Their counts and smallest ids are then verified exactly by
one pre-aggregated pass, and this table of at most ``tracked`` rows is broadcast: the copies of a
frequent text leave on the map side, however many rows they are. Every other digest goes through an
ordinary shuffle, where no group is frequent any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import durable

#: Frequent digests looked for, which bounds the broadcast; and counters kept by the summary.
TRACKED, COUNTERS = 256, 8192


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space replaced by one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def frequent(rows: DataFrame, digest: str, key: str, tracked: int = TRACKED) -> DataFrame:
    """(digest, _keep, _size) of the frequent digests: summary first, then exact verification."""
    hashed = F.xxhash64(digest)
    summary = rows.agg(F.expr(f"approx_top_k(xxhash64(`{digest}`), {tracked}, {COUNTERS})").alias("top"))
    named = summary.select(F.explode("top").alias("top")).select(F.col("top.item").alias("_item"))
    return (
        rows.join(F.broadcast(named), hashed == F.col("_item"), "left_semi")
        .groupBy(digest)
        .agg(F.min(key).alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where((F.col("_size") > 1) & F.col("_keep").isNotNull())
    )


def _split(rows: DataFrame, winners: DataFrame, digest: str, key: str):
    """Rows with their winner, as (copies that a winner drops, everything else)."""
    joined = rows.join(F.broadcast(winners), digest, "left")
    drops = F.col("_keep").isNotNull() & ~F.col(key).eqNullSafe(F.col("_keep"))
    return joined.where(drops), joined.where(~drops)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays; a null text equals an empty one, a null key
    comes after all others, and of rows that repeat key and text one stays. An empty table gives an
    empty table. Other columns of ``docs`` play no part, whatever their names.
    """
    rows = durable(docs.select(F.col(f"`{key}`").alias("_key"), text_digest(F.col(f"`{text}`")).alias("text_sha256")))
    winners = frequent(rows, "text_sha256", "_key")
    copies, rest = _split(rows, winners, "text_sha256", "_key")
    group = Window.partitionBy("text_sha256")
    rest = rest.select(
        "_key",
        F.min("_key").over(group).alias("keep_id"),
        F.coalesce("_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("_key").asc_nulls_last())) == 1).alias("kept"),
        "text_sha256",
    )
    dropped = copies.select(
        "_key", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.lit(False).alias("kept"), "text_sha256",
    )
    return rest.unionByName(dropped).withColumnRenamed("_key", key)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows ``exact_groups`` does not keep; all columns stay as they are.

    Copies of frequent texts leave before the shuffle; the others move once.
    """
    whole = docs.select(
        F.struct("*").alias("doc"), F.col(f"`{key}`").alias("_key"), text_digest(F.col(f"`{text}`")).alias("_sha")
    )
    winners = frequent(durable(whole.select("_key", "_sha")), "_sha", "_key")
    _, rest = _split(whole, winners, "_sha", "_key")
    first = Window.partitionBy("_sha").orderBy(F.col("_key").asc_nulls_last())
    return rest.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc.*")
