"""Removal of passages that repeat across documents, by suffix arrays.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts in a document with a smaller
key. Four steps, none of which holds more than one shard or bucket in a task:

1. Documents are laid out in shards of text, a table bucketed by shard, so that later joins on the
   shard never move the text again.
2. Each window of a text has an anchor, the gram of smallest hash in it: equal windows have equal
   anchors. The sorted anchors of the shards meet in buckets of the hash space, where binary search
   finds those of more than one shard; each shard gets back one bit per anchor. Anchors of one
   document only need no further look.
3. The stretches of text around repeated anchors, each different one once per shard, go to the
   bucket of their anchor. There a suffix array over them (Larsson-Sadakane refinement, to the
   length of the window) and Kasai's common prefixes gather equal windows, and each gets the
   smallest key of its documents. Stretches of a very frequent anchor are cut into single windows
   first and dealt out by the hash of the window, so no anchor is a hot group.
4. The keys go back to the shards, which mark and drop the bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.session import durable, tables_folder

#: Bytes of a repeated string, and of the grams anchors are chosen from.
WINDOW, GRAM = 50, 16
#: Bytes of text of a shard (a longer document is a shard by itself) and of the piece of it that is
#: looked at in one step; text whose anchors and whose stretches share a bucket; stretches of one
#: anchor over which it counts as very frequent; text of a bucket of the table of shards. These set
#: memory and row sizes, never the result.
SHARD_BYTES, BLOCK, ANCHOR_BYTES, STRETCH_BYTES, FREQUENT = 8 << 20, 1 << 19, 32 << 20, 1 << 20, 20_000
TABLE_BYTES = 64 << 20
#: Key of rows without one; the bits of a place within a block.
LAST, PLACE = np.int64(2**63 - 1), np.uint64((1 << 24) - 1)


# ---- shards of text


def _lay_out(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(shard, size, data, ends, keys, docs) rows; ``docs`` has the other columns of each document."""
    others = [f for f in docs.schema.fields if f.name != text]
    names = [f"c{i}" for i in range(len(others))]
    struct = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, others)])
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("data", T.BinaryType()), T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(struct)),
    ])
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
        *(F.col(f"`{f.name}`").alias(n) for n, f in zip(names, others)),
    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            if not len(texts):
                continue
            offset = np.dtype(np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
            places = np.frombuffer(texts.buffers()[1], offset, len(texts) + 1, texts.offset * offset.itemsize)
            whole, sizes, begin = memoryview(texts.buffers()[2] or b""), np.diff(places), 0
            while begin < len(texts):
                total = np.cumsum(sizes[begin:], dtype=np.int64)
                stop = begin + max(1, int(np.searchsorted(total, limit, side="right")))  # a longer text alone
                part = batch.slice(begin, stop - begin)
                ends = np.cumsum(sizes[begin:stop], dtype=np.int64)
                data = bytes(whole[places[begin] : places[stop]])
                inner = pa.StructArray.from_arrays([part.column(n) for n in names], names=names)
                begin = stop
                yield pa.RecordBatch.from_arrays([
                    pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([len(data)], pa.int64()),
                    pa.array([data], pa.binary()), pa.array([ends.tolist()], pa.list_(pa.int64())),
                    pa.array([part.column("key").to_pylist()], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner),
                ], names=["shard", "size", "data", "ends", "keys", "docs"])

    return rows.mapInArrow(lay, schema)


def _bucketed(shards: DataFrame, size: int) -> DataFrame:
    """Write the shards as a table bucketed by shard: joins on it leave the text where it is.

    A bucket is read by one task, so their number follows from the bytes of text.
    """
    session = shards.sparkSession
    name = "adlens_shards_" + uuid.uuid4().hex
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), size // TABLE_BYTES)
    buckets = min(buckets, int(session.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    (shards.write.bucketBy(buckets, "shard").option("compression", "zstd")
     .option("path", f"{tables_folder(session)}/{name}").saveAsTable(name))
    return session.table(name)


# ---- anchors


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes at each of the first ``count`` places as numbers; ``data`` is padded enough."""
    return np.ndarray((count,), "<u8", data, 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _gram_hashes(data: np.ndarray, count: int) -> np.ndarray:
    words = np.ascontiguousarray(_words(data, count + GRAM - 8))
    return _mixed(words[:count] + np.uint64(0xA24BAED4963EE407) * (words[GRAM - 8 :] ^ (words[GRAM - 8 :] >> np.uint64(31))))


def anchors(data: bytes, ends: np.ndarray, block: int = BLOCK):
    """(hash, first, last): for each anchor the range of window starts that it stands for.

    The anchor of a window is its leftmost gram of smallest hash, so it depends on the window alone.
    Windows never cross documents. Works block by block; a cut only splits ranges.
    """
    padded = np.frombuffer(data + bytes(16), np.uint8)
    starts, span = len(data) - WINDOW + 1, WINDOW - GRAM + 1
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    ends = np.asarray(ends, np.int64)
    for begin in range(0, max(0, starts), block):
        count = min(block, starts - begin)
        hashes = _gram_hashes(padded[begin:], count + span - 1)
        # Smallest (high bits of the hash, place) of each window: ties go to the leftmost place.
        least, width = hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:count], least[span - width : span - width + count])
        place = (least & PLACE).astype(np.int64)
        inside = np.ones(count, bool)
        document_end = ends[np.searchsorted(ends, begin, side="right") :]
        for end in document_end[document_end < begin + count + WINDOW - 1].tolist():
            inside[max(0, end - WINDOW + 1 - begin) : max(0, end - begin)] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        new = np.r_[True, (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)]
        first, last = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
        found.append((_mixed(hashes[place[first]]), first + begin, last + begin))  # minima are no even spread
    return tuple(np.concatenate(c) for c in zip(*found))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _packed(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash; the bucket has the high bits, and a chance match costs only work.

    From 2^16 buckets on the two overlap and no bit is lost.
    """
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 48) - 1)


def _anchor_list(hashes: np.ndarray, first: np.ndarray, ends: np.ndarray, bits: int):
    """Different anchors in order of (bucket, low bits): inverse, occurrences, of two documents."""
    shift = np.uint64(64 - min(bits, 16))
    order_key = (hashes >> shift << np.uint64(48)) | _low(hashes)
    different, inverse, times = np.unique(order_key, return_inverse=True, return_counts=True)
    document = np.searchsorted(ends, first, side="right")
    low, high = np.full(len(different), len(ends)), np.zeros(len(different), np.int64)
    np.minimum.at(low, inverse, document)
    np.maximum.at(high, inverse, document)
    bucket = _bucket(different, max(bits, 16))
    return bucket, _low(different), inverse, times, low < high


def _announce(bits: int):
    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, ends in zip(batch.column("shard").to_pylist(), batch.column("data"), batch.column("ends")):
                ends = ends.values.to_numpy()
                hashes, first, _ = anchors(data.as_py(), ends)
                bucket, low, _, times, _ = _anchor_list(hashes, first, ends, bits)
                names, begins = np.unique(bucket, return_index=True)
                cuts = np.r_[begins, len(bucket)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int64()),
                    pa.array([_packed(low[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([np.minimum(times[a:b], 255).astype(np.uint8).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ], names=["bucket", "shard", "low", "times"])

    return announce


def _meet(frequent: int):
    """Which anchors of a bucket are in more than one shard, as one bit for each shard's anchors."""

    def meet(table: pa.Table) -> pa.Table:
        lists = [_unpacked(b.as_py()) for b in table.column("low")]
        times = [np.frombuffer(b.as_py(), np.uint8) for b in table.column("times")]
        everything = np.concatenate(lists)
        order = np.argsort(everything)
        everything = everything[order]
        starts = np.flatnonzero(np.r_[True, everything[1:] != everything[:-1]])
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), starts)
        several = np.diff(np.r_[starts, len(everything)]) > 1
        shared, total = everything[starts][several], total[several]
        marks, often = [], []
        for one in lists:  # binary search of each sorted list in the sorted repeated anchors
            at = np.minimum(np.searchsorted(shared, one), max(0, len(shared) - 1))
            hit = shared[at] == one if len(shared) else np.zeros(len(one), bool)
            marks.append(np.packbits(hit).tobytes())
            many = hit & (total[at] > frequent) if len(shared) else hit
            often.append(np.flatnonzero(many).astype(np.uint32).tobytes())
        return pa.table({
            "shard": table.column("shard"), "bucket": table.column("bucket"),
            "marks": pa.array(marks, pa.binary()), "often": pa.array(often, pa.binary()),
        })

    return meet


# ---- stretches of text around repeated anchors


def _stretches(data: bytes, ends: np.ndarray, keys: np.ndarray, marks: list, bits: int, spread: int):
    """The different stretches of a shard and where they occur.

    Gives (bucket, length, bytes as rows, least key) of the different ones, ordered by bucket, and
    (which, start, key) of the occurrences.
    """
    hashes, first, last = anchors(data, ends)
    bucket, low, inverse, _, several = _anchor_list(hashes, first, ends, bits)
    names, begins = np.unique(bucket, return_index=True)
    cuts = dict(zip(names.tolist(), zip(begins.tolist(), np.r_[begins[1:], len(bucket)].tolist())))
    shared, often = several, np.zeros(len(bucket), bool)
    for mark in marks:
        a, b = cuts[mark["bucket"]]
        shared[a:b] |= np.unpackbits(np.frombuffer(mark["marks"], np.uint8), count=b - a).astype(bool)
        often[a + np.frombuffer(mark["often"], np.uint32).astype(np.int64)] = True
    keep = shared[inverse]
    hashes, first, last, single = hashes[keep], first[keep], last[keep], often[inverse][keep]
    if single.any():  # very frequent anchors: one stretch for each window
        counts = np.where(single, last - first + 1, 1)
        at = np.repeat(np.arange(len(first)), counts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes, single = hashes[at], single[at]
        first = first[at] + step
        last = np.where(single, first, last[at])
    length = last - first + WINDOW
    widest = 2 * WINDOW - GRAM
    widest += -widest % 8
    padded = np.frombuffer(data + bytes(widest), np.uint8)
    parts = []
    for begin in range(0, len(first), 1 << 17):
        rows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, widest), (1, 1))[first[begin : begin + (1 << 17)]]
        rows[np.arange(widest) >= length[begin : begin + (1 << 17), None]] = 0
        parts.append(rows)
    rows = np.concatenate(parts) if parts else np.empty((0, widest), np.uint8)
    key = keys[np.searchsorted(ends, first, side="right")]
    own, which = _different(rows, length)
    place = np.where(single[own], _bucket(_mixed(_row_hash(rows[own], length[own], 7)), spread), _bucket(hashes[own], spread))
    order = np.lexsort((own, place))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    own, which, place = own[order], back[which], place[order]
    least = np.full(len(own), LAST)
    np.minimum.at(least, which, key)
    return (place, length[own], rows[own], least), (which, first, key)


def _row_hash(rows: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    out = _mixed(length.astype(np.uint64) + np.uint64(seed))
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        out = _mixed(out ^ word) + word
    return out


def _different(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each different row, and for each row which of them it equals; exact."""
    seed = 0
    while True:
        _, own, which = np.unique(_row_hash(rows, length, seed), return_index=True, return_inverse=True)
        if (rows == rows[own[which]]).all() and (length == length[own[which]]).all():
            return own, which
        seed += 1


def _marks(batch: pa.RecordBatch, row: int, name: str) -> list:
    listed = batch.column(name)[row]
    return listed.as_py() or []


def _shard(batch: pa.RecordBatch, row: int):
    data = batch.column("data")[row].as_py()
    ends = batch.column("ends")[row].values.to_numpy()
    keys = np.array([LAST if k is None else k for k in batch.column("keys")[row].as_py()], np.int64)
    return data, ends, keys


def _send(bits: int, spread: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, ends, keys = _shard(batch, row)
                (place, length, rows, least), _ = _stretches(data, ends, keys, _marks(batch, row, "marks"), bits, spread)
                names, begins = np.unique(place, return_index=True)
                cuts = np.r_[begins, len(place)]
                filled = np.arange(rows.shape[1]) < length[:, None]
                parts = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array([batch.column("shard")[row].as_py()] * len(names), pa.int64()),
                    pa.array([length[a:b].astype(np.uint8).tobytes() for a, b in parts], pa.binary()),
                    pa.array([rows[a:b][filled[a:b]].tobytes() for a, b in parts], pa.binary()),
                    pa.array([least[a:b].tobytes() for a, b in parts], pa.binary()),
                ], names=["bucket", "shard", "lengths", "texts", "least"])

    return send


# ---- suffix array of a bucket


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in order of the ``depth`` bytes that follow, by Larsson-Sadakane refinement.

    Sorts by eight bytes, then doubles: places that are not alone in their group are sorted by the
    group of the place further on, until ``depth`` bytes are told apart. Behind the end are zeros.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(depth + 8, np.uint8)]
    first = _words(padded, n).byteswap()
    order = np.argsort(first, kind="stable").astype(np.int32)
    new = np.r_[True, first[order[1:]] != first[order[:-1]]]
    # The rank of a place is where its group begins; places behind the end rank lowest.
    rank = np.zeros(n + depth + 8, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)) + 1
    del first
    known = 8
    while known < depth:
        step = min(known, depth - known)
        alone = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        places = order[slots]
        pair = rank[places].astype(np.int64) * (n + 1) + rank[places + step]
        by = np.argsort(pair, kind="stable")
        pair, places = pair[by], places[by]
        order[slots] = places
        begins = np.r_[True, pair[1:] != pair[:-1]]
        new[slots] = begins
        rank[places] = np.maximum.accumulate(np.where(begins, slots, 0)) + 1
        known += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one before it, up to ``depth``, by Kasai.

    A place shares at least one byte less than the place before it in the text. All stretches of
    the text (``starts``) are walked side by side. Order beyond ``depth`` bytes is not known, so a
    place that shared all of them hands nothing on.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(depth + 16, np.uint8)]
    words = _words(padded, n + depth + 8)
    place_in = np.empty(n, np.int32)
    place_in[order] = np.arange(n, dtype=np.int32)
    shared = np.zeros(n, np.uint8)
    sizes = np.diff(np.r_[starts, n])
    by_size = np.argsort(-sizes, kind="stable")
    begin, size = starts[by_size], sizes[by_size]
    carried = np.zeros(len(begin), np.int64)
    for step in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size, -step, side="left"))
        at = begin[:active] + step
        slot = place_in[at]
        before = order[np.maximum(slot - 1, 0)]
        have = np.where(carried[:active] >= depth, 0, np.maximum(carried[:active] - 1, 0))
        go = np.flatnonzero(slot > 0)
        while len(go):
            differ = words[at[go] + have[go]] ^ words[before[go] + have[go]]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
            have[go] += same
            go = go[(same == 8) & (have[go] < depth)]
        have = np.where(slot > 0, np.minimum(have, depth), 0)
        shared[slot] = have
        carried[:active] = have
    return shared


def _least_keys(lengths: np.ndarray, texts: np.ndarray, least: np.ndarray):
    """For every window of every stretch the smallest key of a stretch that has it; and its stretch."""
    starts = np.cumsum(lengths) - lengths
    order = suffix_array(texts, WINDOW)
    shared = common_prefixes(texts, order, starts, WINDOW)
    stretch = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    whole = np.arange(len(texts)) - starts[stretch] <= lengths[stretch] - WINDOW
    key = np.where(whole, least[stretch], LAST)[order]
    groups = np.flatnonzero(shared < WINDOW)
    smallest = np.minimum.reduceat(key, groups)
    of_place = np.empty(len(texts), np.int64)
    of_place[order] = np.repeat(smallest, np.diff(np.r_[groups, len(order)]))
    return of_place[whole], stretch[whole]


def _match(table: pa.Table) -> pa.Table:
    """Answers for the stretches of a bucket: runs of windows whose smallest key is below their own."""
    lengths = [np.frombuffer(b.as_py(), np.uint8).astype(np.int64) for b in table.column("lengths")]
    counts = np.array([len(x) for x in lengths])
    length = np.concatenate(lengths)
    text = np.concatenate([np.frombuffer(b.as_py(), np.uint8) for b in table.column("texts")])
    least = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("least")])
    # The same stretch comes from many shards: it is sorted once, with its smallest key.
    widest = 2 * WINDOW - GRAM
    widest += -widest % 8
    rows = np.zeros((len(length), widest), np.uint8)
    rows[np.arange(widest) < length[:, None]] = text
    own, which = _different(rows, length)
    smallest = np.full(len(own), LAST)
    np.minimum.at(smallest, which, least)
    kept = length[own]
    window_key, stretch = _least_keys(kept, rows[own][np.arange(widest) < kept[:, None]], smallest)
    begins = np.flatnonzero(np.r_[True, (stretch[1:] != stretch[:-1]) | (window_key[1:] != window_key[:-1])])
    run_stretch, run_key = stretch[begins], window_key[begins]
    run_length = np.diff(np.r_[begins, len(stretch)])
    window_start = np.cumsum(kept - WINDOW + 1) - (kept - WINDOW + 1)
    run_offset = begins - window_start[run_stretch]
    # Each copy gets the runs of its stretch.
    run_counts = np.bincount(run_stretch, minlength=len(own))
    run_first = np.cumsum(run_counts) - run_counts
    copies = np.repeat(np.arange(len(which)), run_counts[which])
    run = np.arange(len(copies)) - np.repeat(np.cumsum(run_counts[which]) - run_counts[which], run_counts[which]) + run_first[which[copies]]
    lower = run_key[run] < least[copies]
    copies, run = copies[lower], run[lower]
    source = np.repeat(np.arange(len(counts)), counts)[copies]
    index = copies - (np.cumsum(counts) - counts)[source]
    cuts = np.searchsorted(source, np.arange(len(counts) + 1))
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    blob = lambda column, kind: pa.array([column[p].astype(kind).tobytes() for p in parts], pa.binary())
    return pa.table({
        "shard": table.column("shard"), "bucket": table.column("bucket"),
        "which": blob(index, np.int32), "offset": blob(run_offset[run], np.uint8),
        "length": blob(run_length[run], np.uint8), "key": blob(run_key[run], np.int64),
    })


# ---- removal


def _removed(data: bytes, ends: np.ndarray, keys: np.ndarray, marks: list, answers: list, bits: int, spread: int) -> np.ndarray:
    """Which bytes of a shard go."""
    (place, length, _, least), (which, start, key) = _stretches(data, ends, keys, marks, bits, spread)
    windows = length - WINDOW + 1
    base = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    names, begins = np.unique(place, return_index=True)
    at = dict(zip(names.tolist(), begins.tolist()))
    for answer in answers:
        stretch = np.frombuffer(answer["which"], np.int32).astype(np.int64) + at[answer["bucket"]]
        run = np.frombuffer(answer["length"], np.uint8).astype(np.int64)
        first = base[stretch] + np.frombuffer(answer["offset"], np.uint8)
        step = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        smallest[np.repeat(first, run) + step] = np.repeat(np.frombuffer(answer["key"], np.int64), run)
    change = np.zeros(len(data) + 1, np.int32)
    for begin in range(0, len(which), 1 << 16):
        some = slice(begin, begin + (1 << 16))
        count = windows[which[some]]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        goes = smallest[np.repeat(base[which[some]], count) + step] < np.repeat(key[some], count)
        first = (np.repeat(start[some], count) + step)[goes]
        np.add.at(change, first, 1)
        np.add.at(change, first + WINDOW, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _finish(bits: int, spread: int, names: list[str], with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, ends, keys = _shard(batch, row)
                gone = _removed(data, ends, keys, _marks(batch, row, "marks"), _marks(batch, row, "answers"), bits, spread)
                text = np.frombuffer(data, np.uint8)
                starts = np.r_[0, ends[:-1]]
                sums = np.r_[np.int32(0), np.cumsum(gone, dtype=np.int32)]
                enters = gone & ~np.r_[False, gone[:-1]]
                at_start = starts[starts < len(gone)]
                enters[at_start] = gone[at_start]
                spans = np.r_[np.int32(0), np.cumsum(enters, dtype=np.int32)]
                kept = [text[a:b][~gone[a:b]].tobytes() for a, b in zip(starts, ends)]
                docs = batch.column("docs")[row].values
                columns = [docs.field(n) for n in names] + [
                    pa.array(ends - starts, pa.int64()), pa.array((sums[ends] - sums[starts]).astype(np.int64)),
                    pa.array((spans[ends] - spans[starts]).astype(np.int64)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                if with_text:
                    columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                made = pa.RecordBatch.from_arrays(columns, names=names + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
                for begin in range(0, made.num_rows, 2000):
                    yield made.slice(begin, 2000)

    return finish


def _run(docs: DataFrame, key: str, text: str, with_text: bool, shard_bytes: int, anchor_bytes: int, stretch_bytes: int, frequent: int):
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    shards = _bucketed(_lay_out(docs, key, text, shard_bytes), size)
    bits = min(40, max(6, int(size // anchor_bytes).bit_length()))
    spread = min(40, max(6, int(size // stretch_bytes).bit_length()))
    announced = shards.select("shard", "data", "ends").mapInArrow(
        _announce(bits), "bucket long, shard long, low binary, times binary")
    marks = announced.groupBy("bucket").applyInArrow(_meet(frequent), "shard long, bucket long, marks binary, often binary")
    marks = durable(marks.groupBy("shard").agg(F.collect_list(F.struct("bucket", "marks", "often")).alias("marks")))
    marked = shards.join(marks, "shard", "left")
    sent = marked.select("shard", "data", "ends", "keys", "marks").mapInArrow(
        _send(bits, spread), "bucket long, shard long, lengths binary, texts binary, least binary")
    answers = sent.groupBy("bucket").applyInArrow(
        _match, "shard long, bucket long, which binary, offset binary, length binary, key binary")
    answers = durable(answers.where(F.octet_length("which") > 0).groupBy("shard").agg(
        F.collect_list(F.struct("bucket", "which", "offset", "length", "key")).alias("answers")))
    answered = marked.join(answers, "shard", "left")
    struct = shards.schema["docs"].dataType.elementType
    schema = T.StructType([
        *struct.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept", T.StringType())] if with_text else []),
    ])
    made = answered.select("data", "ends", "keys", "docs", "marks", "answers").mapInArrow(
        _finish(bits, spread, struct.fieldNames(), with_text), schema)
    return made, [c for c in docs.columns if c != text], struct.fieldNames()


def passage_report(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
                   anchor_bytes: int = ANCHOR_BYTES, stretch_bytes: int = STRETCH_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, a null text is empty. ``key`` must be a whole number; a null key counts
    as larger than any other. Rows that repeat a key do not remove each other's text, as neither
    key is smaller. An empty table stays empty.
    """
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    made, _, names = _run(slim, key, text, False, shard_bytes, anchor_bytes, stretch_bytes, frequent)
    return made.withColumnRenamed(names[0], key)


def drop_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars",
                  shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES, stretch_bytes: int = STRETCH_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with the remaining text in place of the text, all rows and columns kept.

    Where a removal cuts a character in two, the rest of that character goes too. A column named
    ``length``, if there is one, gets the new number of characters.
    """
    made, others, names = _run(docs, key, text, True, shard_bytes, anchor_bytes, stretch_bytes, frequent)
    named = dict(zip(others, names))
    columns = []
    for field in docs.schema.fields:
        if field.name == text:
            columns.append(F.col("kept").alias(text))
        elif field.name == length:
            columns.append(F.length("kept").cast(field.dataType).alias(length))
        else:
            columns.append(F.col(named[field.name]).alias(field.name))
    return made.select(*columns)
