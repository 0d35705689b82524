"""Near-duplicates by 64-bit SimHash and a forest of vantage-point trees.

Fingerprints that differ in at most ``RADIUS`` bits are linked. The distance of 64 random bits to
any vantage point has a spread of four bits, so one tree over all bits would send two queries in
three across each boundary. The forest therefore measures Hamming distance on *views*: the bits
fall into ``BLOCKS`` blocks, a view keeps all but ``RADIUS`` of them, and any linked pair agrees on
all bits of at least one view. There its distance is zero, and the triangle bound says that both
have the same distance to every vantage point: a shard is the set of fingerprints with the same
distances to the vantage points of a view, and no linked pair leaves it. Inside a shard all 64 bits
count and the radius is ``RADIUS``: a shard that is too large is cut into rings around one of its
members, whose overlapping borders are visited from both sides, and each piece is searched by a
vantage-point tree that drops branches by the triangle bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.components import components
from adlens.session import durable

#: Words of a shingle, seed of the hash, bits that may differ, blocks of bits.
WIDTH, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
#: Most members of a shard that is searched in one piece, members of a tree's leaf, width of a
#: ring, rows searched at a time.
PIECE, LEAF, RING, ROWS = 16_384, 48, 8, 1 << 18


# ---- fingerprints


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of the word shingles of a text; a bit is set if it is set in over half of them."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else iter([words])
    hashes = map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED))
    ones = np.zeros(64, np.int64)
    for begin in range(0, count, 1 << 16):
        block = np.fromiter(hashes, np.uint64, min(1 << 16, count - begin)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(block[:, byte], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                 *also: Column) -> DataFrame:
    """(key, fp) per row, ``fp`` as a signed 64-bit number, and the columns ``also``."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made = np.fromiter((fingerprint(t, width) for t in batch), np.uint64, len(batch))
            yield pd.Series(made.view(np.int64))

    return docs.select(F.col(f"`{key}`").alias("key"), of(F.col(f"`{text}`")).alias("fp"), *also)


# ---- shards


def _masks(radius: int, blocks: int) -> list[int]:
    cut = np.array_split(np.arange(64), blocks)
    block = [sum(1 << int(b) for b in part) for part in cut]
    return [sum(kept) for kept in combinations(block, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _vantage_points(view: int, bits: int) -> list[int]:
    """Fixed pseudo-random words: data of any kind have spread-out distances to them.

    As many as there is room for their distances in one 64-bit number.
    """
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(f"{view} {i}") for i in range(int(56 / np.log2(bits + 1)))]


def _place(fp: Column, view: int, mask: int) -> Column:
    """The distances to the vantage points of a view in one number."""
    place, bits = F.lit(view).cast("long"), bin(mask).count("1")
    for point in _vantage_points(view, bits):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(point & mask))).bitwiseAND(F.lit(_signed(mask))))
        place = place * F.lit(bits + 1) + distance
    return place


def shards(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(shard, part, fp): every fingerprint in its shard of each view, large shards in pieces.

    A piece is a ring around the smallest member, and where a ring is still too large, a pair of
    salts; members within ``radius`` of the next ring visit it too, so that every pair within
    ``radius`` meets in some piece.
    """
    views = [_place(F.col("fp"), i, mask) for i, mask in enumerate(_masks(radius, blocks))]
    rows = fps.select("fp", F.explode(F.array(*views)).alias("shard"))
    large = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("point")).where(F.col("n") > PIECE)
    rows = rows.join(durable(large), "shard", "left")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("point")))
    ring = F.floor(distance / RING)
    rings = F.when(distance % RING >= RING - radius, F.array(ring, ring + 1)).otherwise(F.array(ring))
    salts = F.ceil(F.col("n") / PIECE)
    salt = F.pmod(F.xxhash64("fp"), salts)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), salts - 1),
                        lambda s: F.least(s, salt) * salts + F.greatest(s, salt))
    cut = (
        rows.where("point is not null")
        .select("shard", "fp", meets.alias("meets"), F.explode(rings).alias("ring"))
        .select("shard", "fp", "ring", F.explode("meets").alias("meet"))
        .select("shard", (F.col("ring") * F.lit(1 << 40) + F.col("meet") + 1).alias("part"), "fp")
    )
    whole = rows.where("point is null").select("shard", F.lit(0).cast("long").alias("part"), "fp")
    return whole.unionByName(cut)


# ---- search inside a shard


class _Search:
    """Components of the members of one piece, by a vantage-point tree."""

    def __init__(self, members: np.ndarray, radius: int):
        self.fp, self.radius = members, radius
        self.label = np.arange(len(members))
        self._tree(np.arange(len(members)))

    def _tree(self, at: np.ndarray) -> None:
        work = [at]
        while work:
            at = work.pop()
            if len(at) <= LEAF:
                self._compare(at, at)
                continue
            distance = np.bitwise_count(self.fp[at] ^ self.fp[at[0]])
            middle = int(np.median(distance))
            inner = distance <= middle
            if inner.all():
                middle -= 1
                inner = distance <= middle
            if not inner.any():  # all equally far: no bound tells them apart
                self._compare(at, at)
                continue
            work += [at[inner], at[~inner]]
            # Triangle bound: only members this near to the border can have a partner beyond it.
            self._compare(at[inner & (distance > middle - self.radius)], at[~inner & (distance <= middle + self.radius)])

    def _compare(self, left: np.ndarray, right: np.ndarray) -> None:
        for begin in range(0, len(left), 256):
            some = left[begin : begin + 256]
            near = np.bitwise_count(self.fp[some][:, None] ^ self.fp[right][None, :]) <= self.radius
            near &= self.label[some][:, None] != self.label[right][None, :]
            i, j = np.nonzero(near)
            if len(i):
                self._merge(self.label[some[i]], self.label[right[j]])

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        new = np.arange(len(self.label))
        for x in list(parent):
            new[x] = root(x)
        self.label = new[self.label]


def _links(shard: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal (shard, part), as two columns."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, n])
    u, v = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    linked = np.zeros(len(starts), bool)
    for step in range(1, min(LEAF, int(sizes.max(initial=1)))):
        same = (run[step:] == run[:-step]) & small[step:]
        i = np.flatnonzero(same)
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        linked[run[i]] = True
    for r in np.flatnonzero(linked | (sizes > LEAF)):
        members = fp[starts[r] : starts[r] + sizes[r]]
        label = _Search(members, radius).label
        moved = np.flatnonzero(label != np.arange(len(label)))
        u.append(members[moved])
        v.append(members[label[moved]])
    empty = np.empty(0, np.uint64)
    return np.concatenate(u or [empty]), np.concatenate(v or [empty])


def links(pieces: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links that join, within each piece, all members within ``radius`` of each other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def found(columns):
            u, v = _links(columns[0], columns[1], columns[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "fp")))
            rows += batch.num_rows
            if rows < ROWS:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = int(np.argmax(last))  # the last run may go on in the next batch
            if cut:
                yield found([c[:cut] for c in columns])
            held = [tuple(c[cut:] for c in columns)]
            rows = len(held[0][0])
        if held:
            yield found([np.concatenate(c) for c in zip(*held)])

    laid = pieces.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return laid.mapInArrow(search, "u long, v long")


# ---- the operators


def _roots(known: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, root) of the fingerprints that have a link; ``root`` names the component."""
    linked = components(links(shards(known.select("fp"), radius, blocks), radius))
    return linked.select(F.col("node").alias("fp"), "root")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links, the row's own included. Texts without
    words, null ones too, have fingerprint zero and are linked like any other. Null keys never
    become a component_id unless all keys of a component are null. Repeated rows are kept, an empty
    table stays empty, and other columns play no part.
    """
    rows = durable(fingerprints(docs, key, text, width))
    known = durable(rows.groupBy("fp").agg(F.min("key").alias("least")))
    roots = _roots(known, radius, blocks)
    grouped = known.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = roots.join(grouped, "root").select("fp", "component_id")
    of_all = known.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(durable(of_all), "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _row_digest(key: Column, text: Column) -> Column:
    """SHA-256 of key and text; rows that share it repeat both. A null text equals an empty one."""
    of_key = F.coalesce(F.sha2(key.cast("string"), 256), F.lit("-" * 64))
    return F.unhex(F.sha2(F.concat(of_key, F.coalesce(text, F.lit(""))), 256))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
              radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest key.

    Null keys come after all others, rows of one component and key go by a digest of their text, and
    of rows that repeat key and text one stays. Rows are dropped by that digest, so a key that
    repeats with other texts keeps its rows of other components. Minima are pre-aggregated by
    fingerprint, and only rows that repeat a kept one are numbered.
    """
    rows = durable(fingerprints(docs, key, text, width, _row_digest(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row")))
    first = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    known = durable(rows.groupBy("fp").agg(F.min(first).alias("first")))
    whole_groups = known.join(_roots(known, radius, BLOCKS), "fp", "left").groupBy(F.coalesce("root", "fp"))
    kept = whole_groups.agg(F.min("first").alias("first")).select("first.row", F.lit(True).alias("stays"))
    counted = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(kept, "row", "left")
    marked = durable(counted.where("stays is null or n > 1").select("row", "stays"))
    repeated = durable(marked.where("stays").select("row"))
    whole = docs.select(F.struct("*").alias("doc"), _row_digest(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"))
    number = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    one_each = whole.join(repeated, "row", "left_semi").withColumn("n", number).where("n = 1")
    return whole.join(marked, "row", "left_anti").select("doc.*").unionByName(one_each.select("doc.*"))
