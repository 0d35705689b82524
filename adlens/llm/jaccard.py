"""Similarity join of word-shingle sets by signature trees.

Two documents link if their sets have a Jaccard similarity of ``PERCENT`` or more. Equal sets are one
*class* from the start. With tokens in any fixed order, the first tokens of two linked sets (as many
as a set may lack, plus one) have one in common; the order puts tokens that a sample shows to be
frequent last. Tokens that stand in several sets send these to shards.

In a shard the sets are rows in order of token and size, with a bitmap of all their tokens. A
signature tree stands over the rows: a node holds the OR and the AND of its bitmaps and the ranges of
its tokens, sizes and classes. Two nodes are visited together from the roots down and dropped when no
pair below them can link: no common token, sizes too far apart, too small an overlap at most (a set
lacks at least the bits that all of its node have and none of the other has), or one class already.

The pairs left are compared by longer bitmaps of parities and then token by token. A first round
takes from each shard only pairs that join classes of candidates (a forest, never more than rows); a
second round, knowing the classes of the first, takes every pair of different classes left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.components import components
from adlens.operators.spread import SALTS, attach
from adlens.session import durable

#: Words of a shingle, least similarity in percent, seed of the word hashes.
WIDTH, PERCENT, SEED = 3, 90, 42
#: Rows a shard holds about, rows of one token that are searched in one piece.
SHARD_ROWS, PIECE = 60_000, 4_096
#: Documents of the sample, least sets of it with a frequent token, most such tokens.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 6, 200_000
#: Rows of a leaf, children of a node, 64-bit words of a bitmap, leaf pairs compared at a time.
LEAF, FAN, BITMAP, PAIRS = 16, 8, 8, 4_096
#: Bytes of a text that are split into words at a time, texts whose sets are held at a time.
TEXT_PIECE, CHUNK = 4 << 20, 256

_SPACE = frozenset(b" \t\n\r\x0b\x0c")


# ---- sets


def _words(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text with A-Z in lower case, piece by piece; no word is cut."""
    data = (text or "").encode().lower()
    begin = 0
    while begin < len(data):
        end = begin + TEXT_PIECE
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[begin:end].split()
        begin = end


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def token_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words make one shingle, none no set.

    A word is hashed by XXH64, a shingle by mixing the hashes of its words in order. Two different
    shingles of compared texts share a hash with a chance of 2^-64.
    """
    from xxhash import xxh64_intdigest

    parts = [np.fromiter((xxh64_intdigest(w, SEED) for w in some), np.uint64, len(some)) for some in _words(text)]
    hashes = np.concatenate(parts or [np.empty(0, np.uint64)])
    if not len(hashes):
        return hashes
    used = min(width, len(hashes))
    count = len(hashes) - used + 1
    mixed = np.full(count, used, np.uint64)
    for i in range(used):
        mixed = _mix(mixed + hashes[i : i + count])
    return np.unique(mixed)


def _needed(size, percent: int):
    """Fewest common tokens of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def _overlap(a, b, percent: int):
    """Fewest common tokens of two linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _first_tokens(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[: len(tokens) - _needed(len(tokens), percent) + 1]


def _bitmap(tokens: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """One bit per token, some share one."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(tokens >> np.uint64(40)).astype(np.int64) % (64 * words)] = 1
    return np.packbits(bits).view(np.uint64)


def _parity_bits(size: int) -> int:
    return max(256, 1 << int(size).bit_length())


def _parities(tokens: np.ndarray) -> bytes:
    """One bit per place, set if an odd number of tokens fall there; places grow with the set."""
    places = _parity_bits(len(tokens))
    count = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _differing(a: int, b: int, bits_a: int, bits_b: int) -> int:
    """Fewest tokens that only one of two sets has, from their parities; a longer one is folded."""
    while bits_a > bits_b:
        bits_a //= 2
        a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
    while bits_b > bits_a:
        bits_b //= 2
        b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
    return (a ^ b).bit_count()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, so that what is made of them stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, CHUNK):
            yield batch.slice(begin, CHUNK)


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def frequent_tokens(docs: DataFrame, text: str = "text", width: int = WIDTH, sample: int = SAMPLE) -> np.ndarray:
    """Sorted tokens that stand in several sets of a sample of about ``sample`` documents.

    Any list gives the same links; it only decides which tokens come late. At most
    ``MOST_FREQUENT`` tokens reach the driver.
    """
    every = max(1, docs.count() // sample)
    picked = docs.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).where(F.pmod("_at", F.lit(every)) == 0)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches):
            made = [token_set(value, width) for value in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], ["token"])

    counted = picked.select(F.col(f"`{text}`").alias("text")).mapInArrow(tokens, "token bigint").groupBy("token").count()
    top = counted.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                 percent: int = PERCENT) -> DataFrame:
    """(key, text_id, n, set_id, first, bitmap, parities) per row; the last four are null without words."""
    import hashlib

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, text, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in _chunks(batches):
            sizes, ids, first, bitmaps, parities = [], [], [], [], []
            for value in batch.column("text").to_pylist():
                tokens = token_set(value, width)
                sizes.append(len(tokens))
                some = len(tokens) > 0
                ids.append(hashlib.md5(tokens.tobytes()).digest() if some else None)
                first.append(_first_tokens(tokens, late, percent).view(np.int64) if some else None)
                bitmaps.append(_bitmap(tokens).tobytes() if some else None)
                parities.append(_parities(tokens) if some else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()), pa.array(parities, pa.binary())],
                ["key", "text_id", "n", "set_id", "first", "bitmap", "parities"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), _text_id(F.col(f"`{text}`")).alias("text_id"))
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(
        describe, f"key {kind}, text_id binary, n bigint, set_id binary, first array<bigint>, bitmap binary, parities binary")


# ---- shards


def shard_rows(sets: DataFrame) -> DataFrame:
    """(shard, part, token, set_id, n, bitmap, parities): one row for each first token that several sets have.

    Tokens are dealt to shards by hash. A token of more than ``PIECE`` sets has shards of its own:
    its sets are dealt to blocks, and a shard takes two blocks, so that every two sets meet.
    """
    tokens = sets.select("set_id", F.explode("first").alias("token"))
    counted = durable(tokens.groupBy("token").count().where("count > 1"))
    total = counted.agg(F.sum("count")).first()[0] or 0
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-total // SHARD_ROWS))
    blocks = F.ceil(F.col("count") / PIECE)
    block = F.pmod(F.xxhash64("set_id"), blocks)
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1),
                         lambda other: F.least(other, block) * blocks + F.greatest(other, block) + 1)
    part = F.explode(F.when(blocks > 1, pieces).otherwise(F.array(F.lit(0).cast("bigint"))))
    placed = tokens.join(counted, "token").select("set_id", "token", part.alias("part"))
    # A piece of a hot token goes by token and part, so its shards lie in different tasks.
    shard = F.pmod(F.xxhash64("token", "part"), F.lit(shards))
    return placed.join(sets.select("set_id", "n", "bitmap", "parities"), "set_id").select(
        shard.cast("int").alias("shard"), "part", "token", "set_id", "n", "bitmap", "parities")


# ---- the tree of a shard


class _Tree:
    """Nodes over rows in order of token and size; level 0 are the leaves."""

    def __init__(self, token: np.ndarray, size: np.ndarray, bits: np.ndarray):
        self.levels = [self._summed(token, token, size, size, bits, bits, LEAF)]
        while len(self.levels[-1][0]) > FAN:
            self.levels.append(self._summed(*self.levels[-1], FAN))

    @staticmethod
    def _summed(token_low, token_high, size_low, size_high, union, common, step: int):
        at = np.arange(0, len(token_low), step)
        return (np.minimum.reduceat(token_low, at), np.maximum.reduceat(token_high, at),
                np.minimum.reduceat(size_low, at), np.maximum.reduceat(size_high, at),
                np.bitwise_or.reduceat(union, at, axis=0), np.bitwise_and.reduceat(common, at, axis=0))

    def _alive(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may have a linked pair of sets below them."""
        low, high, least, most, union, common = self.levels[level]
        alive = (low[x] <= high[y]) & (low[y] <= high[x])
        alive &= (100 * most[x] >= percent * least[y]) & (100 * most[y] >= percent * least[x])
        at = np.flatnonzero(alive & (x != y))
        a, b = x[at], y[at]
        need = _overlap(least[a], least[b], percent)
        at_most = np.minimum(most[a] - np.bitwise_count(common[a] & ~union[b]).sum(axis=1, dtype=np.int64),
                             most[b] - np.bitwise_count(common[b] & ~union[a]).sum(axis=1, dtype=np.int64))
        alive[at[at_most < need]] = False
        return alive

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs x <= y of leaves left by the traversal from the roots, near ones first."""
        level = len(self.levels) - 1
        x, y = np.triu_indices(len(self.levels[level][0]))
        while True:
            alive = self._alive(level, x, y, percent)
            x, y = x[alive], y[alive]
            if level == 0:
                order = np.argsort(y - x, kind="stable")
                return x[order], y[order]
            level -= 1
            count = len(self.levels[level][0])
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            x, y = (x[:, None] * FAN + i).ravel(), (y[:, None] * FAN + j).ravel()
            real = (x <= y) & (y < count)
            x, y = x[real], y[real]


def _merged(label: np.ndarray, a: list[int], b: list[int]) -> tuple[np.ndarray, list[int]]:
    """Labels after joining the labels a and b of pairs, and which pairs joined two."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    took = []
    for k, (x, y) in enumerate(zip(a, b)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            took.append(k)
    if not up:
        return label, took
    new = np.arange(len(label))
    for x in list(up):
        new[x] = root(x)
    return new[label], took


def candidates(token: np.ndarray, size: np.ndarray, bits: np.ndarray, parities: list, member: np.ndarray,
               label: np.ndarray, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (u, v) of one token and different labels that no bound excludes, and the rows in any.

    Rows come in order of token and size; ``member`` numbers their sets, ``label`` the classes of
    the sets. With ``forest`` a pair joins the labels of its sets, and later pairs of joined labels
    are left out.
    """
    none = np.empty(0, np.int64)
    if not len(token):
        return none, none, none
    number = [None] * len(token)  # parities as whole numbers, made when needed
    found_u, found_v, active = [], [], np.zeros(len(token), bool)
    left, right = _Tree(token, size, bits).leaf_pairs(percent)
    starts = np.arange(0, len(token), LEAF)
    for begin in range(0, len(left), PAIRS):
        x, y = left[begin : begin + PAIRS], right[begin : begin + PAIRS]
        of_row = label[member]
        low, high = np.minimum.reduceat(of_row, starts), np.maximum.reduceat(of_row, starts)
        apart = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
        x, y = x[apart], y[apart]
        u = x[:, None] * LEAF + np.arange(LEAF)
        v = y[:, None] * LEAF + np.arange(LEAF)
        inside_u, inside_v = np.minimum(u, len(token) - 1), np.minimum(v, len(token) - 1)
        same = token[inside_u][:, :, None] == token[inside_v][:, None, :]
        same &= (u < len(token))[:, :, None] & (v < len(token))[:, None, :]
        same &= of_row[inside_u][:, :, None] != of_row[inside_v][:, None, :]
        p, i, j = np.nonzero(same)
        u, v = u[p, i], v[p, j]
        once = u < v
        u, v = u[once], v[once]
        need = _overlap(size[u], size[v], percent)
        at_most = np.minimum(size[u] - np.bitwise_count(bits[u] & ~bits[v]).sum(axis=1, dtype=np.int64),
                             size[v] - np.bitwise_count(bits[v] & ~bits[u]).sum(axis=1, dtype=np.int64))
        fits = at_most >= need
        u, v, room = u[fits], v[fits], (size[u] + size[v] - 2 * need)[fits]
        near = np.zeros(len(u), bool)
        for k, (a, b, most) in enumerate(zip(u.tolist(), v.tolist(), room.tolist())):
            for r in (a, b):
                if number[r] is None:
                    number[r] = int.from_bytes(parities[r], "little")
            near[k] = _differing(number[a], number[b], 8 * len(parities[a]), 8 * len(parities[b])) <= most
        u, v = u[near], v[near]
        active[u] = active[v] = True
        if forest:
            label, took = _merged(label, label[member[u]].tolist(), label[member[v]].tolist())
            u, v = u[took], v[took]
        found_u.append(u)
        found_v.append(v)
    return np.concatenate(found_u or [none]), np.concatenate(found_v or [none]), np.flatnonzero(active)


def _search(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(token, part, a, b) of the candidates of each shard; with ``forest`` also (token, part, a, null) of the sets in any.

    ``rows`` are those of ``shard_rows``, and the ``class`` of a set where ``forest`` is false. A
    task holds one shard at a time.
    """

    def of_shard(table: pa.Table) -> pa.RecordBatch:
        token = table.column("token").to_numpy()
        size = table.column("n").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(token), BITMAP)
        sets = table.column("set_id").combine_chunks().dictionary_encode()
        member = sets.indices.to_numpy().astype(np.int64)
        if forest:
            label = np.arange(len(sets.dictionary))
        else:
            classes = table.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
            label = np.zeros(len(sets.dictionary), np.int64)
            label[member] = classes
        # Parts of one token are apart: a token has one part, or all of its rows have their part in it.
        u, v, active = candidates(token, size, bits, table.column("parities").to_pylist(), member, label, percent, forest)
        more = active if forest else active[:0]
        at = pa.array(np.concatenate([u, more]))
        ids = sets.dictionary
        a = ids.take(pa.array(member[np.concatenate([u, more])]))
        b = pa.concat_arrays([ids.take(pa.array(member[v])), pa.nulls(len(more), ids.type)])
        return pa.RecordBatch.from_arrays(
            [table.column("token").combine_chunks().take(at), table.column("part").combine_chunks().take(at), a, b],
            ["token", "part", "a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                shard = batch.column("shard").to_numpy()
                part = batch.column("part").to_numpy()
                if held:
                    now = (held[0].column("shard")[0].as_py(), held[0].column("part")[0].as_py())
                    stay = int(np.argmax(np.r_[(shard != now[0]) | (part != now[1]), True]))
                    if stay:
                        held.append(batch.slice(0, stay))
                        batch = batch.slice(stay)
                        continue
                    yield of_shard(pa.Table.from_batches(held))
                held = [batch.slice(0, int(np.argmax(np.r_[(shard != shard[0]) | (part != part[0]), True])))]
                batch = batch.slice(held[0].num_rows)
        if held:
            yield of_shard(pa.Table.from_batches(held))

    laid = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "token", "n", "set_id")
    return laid.mapInArrow(search, "token bigint, part bigint, a binary, b binary")


# ---- exact comparison


def _token_sets(docs: DataFrame, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, tokens) of the sets ``wanted`` (set_id, text_id), from one text of each.

    As many as ``attach`` broadcasts are broadcast and no text is moved to find them. Copies of a text
    are reduced to one in two steps, the first by parts of the copies.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches):
            made = pa.array([token_set(value, width).view(np.int64) for value in some.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("set_id"), made], ["set_id", "tokens"])

    texts = docs.select(
        _text_id(F.col(f"`{text}`")).alias("text_id"), F.col(f"`{text}`").alias("text"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"))
    found = attach(texts, wanted, ["text_id"], by=["salt"], how="inner", known_rows=wanted.count())
    one_each = found.dropDuplicates(["text_id", "salt"]).dropDuplicates(["text_id"])
    return one_each.select("set_id", "text").mapInArrow(tokens, "set_id binary, tokens array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by counting the common tokens of each pair, in the JVM: no batch of sets is built."""
    both = (
        pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("left")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("right")), "b")
    )
    common = F.size(F.array_intersect("left", "right")).cast("bigint")
    union = F.size("left") + F.size("right") - F.col("common")
    return both.withColumn("common", common).select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"))


# ---- the operator


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                percent: int = PERCENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key reachable by links).

    Links join texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more; equal sets always link. Null, empty and blank texts have no set and link
    with nothing. Null keys never become a component_id unless all keys of a component are null; a
    row without a set has its own key. Repeated rows are kept, an empty table stays empty, other
    columns play no part.
    """
    rows = durable(shingle_sets(docs, key, text, width, percent))
    worded = rows.where("set_id is not null")
    same = ["n", "first", "bitmap", "parities"]  # equal in all rows of a set
    sets = durable(worded.groupBy("set_id").agg(
        F.min("key").alias("least"), F.min("text_id").alias("text_id"), *[F.first(c).alias(c) for c in same]))
    placed = durable(shard_rows(sets))
    first_round = durable(_search(placed, percent, forest=True))

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        texts = durable(sets.select(F.col("set_id").alias("a"), "text_id").join(wanted, "a"))
        tokens = durable(_token_sets(docs, text, texts.select(F.col("a").alias("set_id"), "text_id"), width))
        return durable(_linked(pairs, tokens, percent))

    tried = compared(first_round.where("b is not null").select("a", "b"))
    found = tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = durable(components(found))
    again = first_round.where("b is null").select("token", "part", F.col("a").alias("set_id"))
    active = placed.join(again, ["token", "part", "set_id"], "left_semi").join(
        classes.select(F.col("node").alias("set_id"), F.col("root")), "set_id", "left")
    left = _search(active.withColumn("class", F.coalesce("root", "set_id")).drop("root"), percent, forest=False)
    pairs = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = compared(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    links = found.unionByName(more.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = durable(components(links).select(F.col("node").alias("set_id"), "root"))
    grouped = sets.select("set_id", "least").join(roots, "set_id").groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = roots.join(grouped, "root").select("set_id", "component_id")
    of_sets = durable(sets.select("set_id", "least").join(of_linked, "set_id", "left").select(
        "set_id", F.coalesce("component_id", "least").alias("component_id")))
    # Rows of one set lie in one group here, so the join may have a hot side; adaptive execution splits it.
    with_id = rows.select("key", "n", "set_id").join(of_sets, "set_id", "left")
    return with_id.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
