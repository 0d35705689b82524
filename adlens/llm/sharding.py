"""Sharding by extendible hashing, DataFrame functions only.

A row's place is a prefix of the bits of its key's hash. The directory starts as one bucket; a
bucket over the byte limit, and only such a bucket, splits on one more bit, until all fit. Instead
of one job per bit, a round looks at several: the bytes of the round's cells are summed once, the
prefixes of its lengths are summed from the cells, and a bucket is the shortest prefix that fits. The
first round stops short of an even split, so its cells are few; only the rows of oversized prefixes
go round again with more bits. The directory is a table of prefixes, never a driver-side structure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import checked, durable

#: Bits of the hash, how many the first round stays below an even split, and bits of a later round.
BITS, BELOW, STEP = 60, 2, 6


def _size(text: str) -> Column:
    """Bytes of the text in UTF-8, 0 for a null text."""
    return F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")


def shard_directory(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, shard, depth, n_bytes, shard_bytes, shard_docs.

    ``shard`` is the hash prefix as 0s and 1s, empty if one shard holds all. n_bytes is the length
    of the text in UTF-8, 0 for a null text. Every shard holds at most ``limit`` bytes, except that
    a row of more than ``limit`` bytes is a shard by itself. Rows that repeat a key share its hash
    and can't be told apart by bits: where they don't fit together, those of equal length fill pages
    up to the limit, each a shard ``prefix.key hash.length.page``. A null key is a key like any other.
    No rows, no shards.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    pending = durable(
        docs.select(
            F.col(f"`{key}`").alias("_key"),
            _size(text).alias("n_bytes"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 1, BITS // 4), 16, 10)
            .cast("long").alias("_hash"),
        )
    )
    total = pending.agg(F.sum("n_bytes")).first()[0] or 0
    seen, bits, placed = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit))) - BELOW)), []
    while True:
        # Sums of all prefixes of length seen..bits, from the cells of this round.
        cells = checked(
            pending.groupBy(F.expr(f"shiftright(_hash, {BITS - bits})").alias("_cell"))
            .agg(F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_docs"))
        )
        prefixes = cells.select("*", F.explode(F.sequence(F.lit(seen), F.lit(bits))).alias("depth"))
        prefixes = prefixes.withColumn("_prefix", F.expr(f"shiftright(_cell, {bits} - depth)"))
        buckets = prefixes.groupBy("depth", "_prefix").agg(
            F.sum("_bytes").alias("shard_bytes"), F.sum("_docs").alias("shard_docs")
        ).where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        found = checked(
            prefixes.join(buckets, ["depth", "_prefix"])
            .groupBy("_cell")
            .agg(F.min(F.struct("depth", "_prefix", "shard_bytes", "shard_docs")).alias("_bucket"))
        )
        rows = pending.withColumn("_cell", F.expr(f"shiftright(_hash, {BITS - bits})"))
        placed.append(
            rows.join(found, "_cell").select("_key", "n_bytes", "_bucket.*").withColumn("_page", F.lit(None).cast("string"))
        )
        if found.count() == cells.count():
            break
        pending = rows.join(found, "_cell", "left_anti").drop("_cell")
        if bits == BITS:
            placed.append(_pages(pending, limit))
            break
        seen, bits = bits + 1, min(BITS, bits + STEP)
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    label = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(_prefix), depth, '0')"))
    return result.select(
        F.col("_key").alias(key), F.concat_ws(".", label, F.col("_page")).alias("shard"), F.col("depth").cast("bigint").alias("depth"),
        "n_bytes", "shard_bytes", "shard_docs",
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows whose hash has no bits left, made from counts: no task holds all rows of a key."""
    cells = rows.groupBy("_key", "_hash", "n_bytes").agg(F.count(F.lit(1)).alias("_n"))
    fill = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1)).cast("long")
    cells = cells.withColumn("_fill", fill)
    last = F.floor((F.col("_n") - 1) / F.col("_fill")).cast("long")
    pages = cells.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = pages.repartition("_hash", "n_bytes", "_at").withColumn(
        "shard_docs", F.least("_fill", F.col("_n") - F.col("_at") * F.col("_fill")))
    name = F.concat_ws(".", F.hex(F.xxhash64("_key")), "n_bytes", "_at")
    return dealt.select(
        "_key", "n_bytes", F.lit(BITS).alias("depth"), F.col("_hash").alias("_prefix"),
        (F.col("shard_docs") * F.col("n_bytes")).alias("shard_bytes"), "shard_docs", name.alias("_page"),
        F.explode(F.sequence(F.lit(1).cast("long"), "shard_docs")).alias("_copy"),
    ).drop("_copy")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text",
                 folder: str = "shard_name") -> DataFrame:
    """Write ``docs`` as one folder ``<folder>=s<shard>`` per shard, each row once, and return the directory.

    Rows of equal key and length are numbered on both sides: any of them may take any of their
    places. ``folder`` must not be a column of ``docs`` (whatever its case): the rows would lose it.
    """
    if folder.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {folder}, name another folder")
    directory = durable(shard_directory(docs, limit, key, text))
    places = directory.select(
        F.col(f"`{key}`").alias("_of"), F.col("n_bytes").alias("_room"), F.concat(F.lit("s"), "shard").alias("_name"),
        F.row_number().over(Window.partitionBy(f"`{key}`", "n_bytes").orderBy("shard")).alias("_place"),
    )
    rows = docs.select(
        F.struct("*").alias("_doc"), F.col(f"`{key}`").alias("_key"), _size(text).alias("_bytes"),
    ).withColumn("_number", F.row_number().over(Window.partitionBy("_key", "_bytes").orderBy("_key")))
    same = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_bytes") == F.col("_room")) & (F.col("_number") == F.col("_place"))
    placed = rows.join(places, same).select("_doc.*", F.col("_name").alias(folder))
    placed.repartition(folder).write.partitionBy(folder).parquet(path)
    return directory
