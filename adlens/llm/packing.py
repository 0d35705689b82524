"""Best-fit packing into sequences of several permitted lengths.

Items of one bin group are taken longest first. An item goes where it leaves the least room; where
no open bin has room, a bin of the least-cost size is opened: its cost less what the room it leaves
is worth to the shorter items still to come. In the end each bin shrinks to the smallest permitted
length that holds its contents. Two ways to open bins are tried, the priced one and always the
largest, and the cheaper packing of the group stays. Groups are even hash parts of a bounded number
of items, so all of them are packed side by side and none holds more than its task can. Items that
agree in key, piece and length are counted and numbered from the count; the number is part of the
hash, so a key that a third of all rows repeat spreads over the groups like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.session import durable

#: Permitted lengths, tokens that a sequence costs besides its length, items of a group on average.
CAPACITIES, OVERHEAD, GROUP_ITEMS = (512, 1024, 2048, 4096, 8192), 32, 20_000
#: Equal items that one row stands for until they are numbered.
NUMBERED = 1_000


def word_tokens(text: Column) -> Column:
    """Words of ASCII-separated text and one end mark; null counts as empty."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(F.regexp_replace(words, "[^w]+", "")) + 1).cast("bigint")


def pieces_of(docs: DataFrame, key: str, length: Column, largest: int) -> DataFrame:
    """(key, piece, length): each document cut into pieces of at most ``largest`` tokens, none lost."""
    sized = docs.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("bigint")
    cut = sized.select("key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select("key", "piece", F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).cast("bigint").alias("length"))


def numbered(items: DataFrame) -> DataFrame:
    """(key, piece, length, number): equal items told apart by a number from 0 on.

    They are counted before they move; the count is cut into blocks, and the blocks are dealt out
    before they become rows again, so no task holds all items of a frequent key.
    """
    cells = items.groupBy("key", "piece", "length").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / NUMBERED).cast("bigint")
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    dealt = blocks.repartition("key", "piece", "length", "block")
    start = F.col("block") * NUMBERED
    numbers = F.sequence(start, F.least(start + NUMBERED, F.col("n")) - 1)
    return dealt.select("key", "piece", "length", F.explode(numbers).alias("number"))


def pack_group(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each item, the cheaper of both ways to open bins.

    ``lengths`` are in order from the longest on. The result depends on this order alone.
    """
    capacities = tuple(sorted(capacities))
    tried = [_pack(lengths.tolist(), capacities, overhead, priced) for priced in (True, False)]
    costs = [sum(_shrunk(used, capacities) + overhead for used in filled) for _, _, filled in tried]
    where, offset, filled = tried[int(costs[1] < costs[0])]
    sizes = np.array([_shrunk(used, capacities) for used in filled], np.int64)
    return np.array(where, np.int64), np.array(offset, np.int64), sizes[where] if len(where) else sizes


def _shrunk(used: int, capacities: tuple[int, ...]) -> int:
    return next(c for c in capacities if c >= used)


def _pack(lengths: list[int], capacities: tuple[int, ...], overhead: int, priced: bool):
    unit = min((c + overhead) / c for c in capacities)
    rest = _rest_below(lengths)
    roomy: dict[int, list[int]] = {}  # bins by the room they have
    rooms = 0  # bit r is set if some bin has room r
    where, offset, filled, size_of = [], [], [], []
    for at, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = roomy[room].pop()
            if not roomy[room]:
                rooms &= ~(1 << room)
        else:
            size = _opened(length, at, rest, capacities, overhead, unit) if priced else capacities[-1]
            chosen, room = len(filled), size
            filled.append(0)
            size_of.append(size)
        where.append(chosen)
        offset.append(filled[chosen])
        filled[chosen] += length
        room -= length
        roomy.setdefault(room, []).append(chosen)
        rooms |= 1 << room
    return where, offset, filled


def _rest_below(lengths: list[int]) -> tuple[np.ndarray, list[int]]:
    """Sums over the items from each place on, and the lengths themselves, longest first."""
    sums = np.zeros(len(lengths) + 1, np.int64)
    sums[:-1] = np.cumsum(np.array(lengths[::-1], np.int64))[::-1]
    return sums, [-x for x in lengths]


def _opened(length: int, at: int, rest, capacities, overhead: int, unit: float) -> int:
    """The size whose cost, less the worth of the room that later items can use, is least."""
    from bisect import bisect_left

    sums, falling = rest
    best, least = capacities[-1], math.inf
    for size in capacities:
        if size < length:
            continue
        room = size - length
        usable = min(room, int(sums[max(at + 1, bisect_left(falling, -room))]))
        cost = size + overhead - usable * unit
        if cost < least:
            best, least = size, cost
    return best


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, text: str = "text",
         capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD,
         group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: key, piece, length, bin_id, bin_size, bin_offset.

    ``length`` is the number of tokens of a document, by default its words and an end mark. Longer
    documents than the largest sequence are cut; every token is in exactly one bin. Rows without
    length, or with a negative one, are pieces of length 0. Pieces that repeat key and number are
    separate items. Ties go by key, then piece, so the result does not depend on the partitioning;
    null keys come last. bin_id is unique over all groups. An empty table gives no rows.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be whole numbers from one on")
    length = word_tokens(F.col(f"`{text}`")) if length is None else length
    items = durable(pieces_of(docs, key, length, max(capacities)))
    groups = max(1, math.ceil(items.count() / group_items))
    kind = items.schema["key"].dataType.simpleString()

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        where, offset, size = pack_group(table.column("length").to_numpy(), capacities, overhead)
        group = table.column("group").to_numpy()
        return pa.table({
            "key": table.column("key"), "piece": table.column("piece"), "length": table.column("length"),
            "bin_id": pa.array(group + where * groups, pa.int64()), "bin_size": pa.array(size, pa.int64()),
            "bin_offset": pa.array(offset, pa.int64()),
        })

    group = F.pmod(F.xxhash64("key", "piece", "length", "number"), F.lit(groups)).cast("bigint")
    spread = numbered(items).withColumn("group", group).drop("number")
    made = spread.groupBy("group").applyInArrow(
        packed, f"key {kind}, piece bigint, length bigint, bin_id bigint, bin_size bigint, bin_offset bigint")
    return made.withColumnRenamed("key", key)
