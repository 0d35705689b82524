"""Bounded samples of labelled documents, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str) -> Column:
    """Rows whose labels are never learnt from; a null key is none of them."""
    rest = F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id",
                  text: str = "text", salt: int = 0) -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled documents, chosen by a hash of the key.

    Only keys and labels are ranked; the chosen ones, a table of known size, are broadcast to the
    documents. Null keys and labels, and held-out rows, are left out; of several labels of one key
    the largest counts, of several texts the one with the smallest SHA-256. Other values of ``salt``
    choose other rows.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key"))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key", F.lit(salt)), "key")
        .limit(rows)
    )
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "key")
    return found.groupBy("key").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), F.max("label").alias("label"))
