"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

The presence of each hashed n-gram is scaled by the logarithm of how much more of the toxic than of
the other training texts hold it; n-grams with a weak ratio or few texts are left out. A logistic
regression is learnt on the scaled features. Both are fitted on a bounded sample of labelled rows,
whose n-grams are counted on Spark; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.labelled import held_out, training_rows
from adlens.session import durable

#: Labelled rows learnt from at most, the tasks that count their n-grams, ranges of hashes summed apart.
TRAIN_ROWS, COUNTERS, RANGES = 20_000, 12, 16
#: Sizes of n-grams in code points of the lower-cased text, bits of their hash, code points of a step.
SIZES, BITS, STEP = (3, 4, 5, 6), 22, 1 << 18
#: Least ratio and least texts of a feature, most features, penalty, steps of the fit, threshold.
RATIO, TEXTS, FEATURES, PENALTY, STEPS, THRESHOLD = 1.5, 8, 50_000, 3e-3, 200, 0.3


@dataclass
class Model:
    """Features by their hash, weight of each (the naive Bayes ratio included), and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def _hashes(data: np.ndarray, begin: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the hashes of the n-grams at ``begin`` and the ``count`` - 1 places after it."""
    rolled = np.zeros(count, np.uint64)
    for size in range(1, max(SIZES) + 1):
        part = data[begin + size - 1 : begin + size - 1 + count].astype(np.uint64)
        rolled = rolled[: len(part)] * np.uint64(0x1F35A7BD3) + part + np.uint64(1)
        if size in SIZES:
            mixed = (rolled + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            yield size, ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def presence(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the different n-grams of each text, in order; only those marked in ``wanted``."""
    coded = [t.lower().encode("utf-32-le") for t in texts]
    ends = np.cumsum([len(c) // 4 for c in coded])
    data = np.frombuffer(b"".join(coded), "<u4")
    found = [np.empty(0, np.uint64)]
    for begin in range(0, len(data), STEP):
        for size, hashes in _hashes(data, begin, min(STEP, len(data) - begin)):
            at = np.arange(len(hashes)) if wanted is None else np.flatnonzero(wanted[hashes.astype(np.int64)])
            owner = np.searchsorted(ends, at + begin, side="right")
            whole = at + begin + size <= ends[owner]
            found.append(np.unique(owner[whole].astype(np.uint64) << np.uint64(BITS) | hashes[at[whole]]))
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32).reshape(2, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold each n-gram, over all rows of a task, by range of hashes."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[int(label > 0.5), presence([text], None)[1]] += 1
    packed = [_pack(part) for part in np.split(counts, RANGES, axis=1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])


def _total(table: pa.Table) -> pa.Table:
    """The counts of one range summed over the tasks."""
    counts = sum(_unpack(packed) for packed in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([_pack(counts)], pa.binary())})


def _examples(features: np.ndarray):
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[features] = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            owner, hashes = presence(texts, wanted)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            at = np.searchsorted(features, hashes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("label"),
                pa.array([at[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ], ["key", "label", "features"])

    return examples


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS,
          key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out part.

    What reaches the driver is bounded by the table of hashes, the number of features and ``rows``.
    Without labelled rows every text scores 0; with labels of one kind only, their smoothed share.
    """
    sample = durable(training_rows(docs, labels, label, rows, key, text))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("label") > 0.5).alias("toxic")).count().collect()}
    yes, no = totals.get(True, 0), totals.get(False, 0)
    if not yes + no:
        return Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    prior = float(np.log((yes + 0.5) / (no + 0.5)))
    if not yes or not no:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    counted = sample.coalesce(COUNTERS).mapInArrow(_count, "part int, counts binary")
    parts = counted.groupBy("part").applyInArrow(_total, "part int, counts binary").collect()
    counts = np.concatenate([_unpack(r.counts) for r in sorted(parts, key=lambda r: r.part)], axis=1)
    held = np.flatnonzero(counts.sum(axis=0) >= TEXTS)
    ratio = np.log((counts[1, held] + 1) / (yes + 2)) - np.log((counts[0, held] + 1) / (no + 2))
    strong = np.abs(ratio) >= RATIO
    held, ratio = held[strong], ratio[strong]
    if len(held) > FEATURES:
        best = np.sort(np.argsort(-np.abs(ratio) * np.sqrt(counts[:, held].sum(axis=0)), kind="stable")[:FEATURES])
        held, ratio = held[best], ratio[best]
    rows_ = sample.mapInArrow(_examples(held), f"key {sample.schema['key'].dataType.simpleString()}, label double, features binary")
    seen = rows_.toArrow()
    by = np.array(sorted(range(seen.num_rows), key=seen.column("key").to_pylist().__getitem__))
    wanted = (seen.column("label").to_numpy() > 0.5).astype(float)[by]
    marked = seen.column("features")
    weights, intercept = _fit(wanted, [np.frombuffer(marked[i].as_py(), np.int32) for i in by.tolist()], ratio, prior)
    return Model(held, weights * ratio, intercept)


def _fit(wanted: np.ndarray, features: list[np.ndarray], ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty by full gradients with a step per feature."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate(features)
    value = ratio[column]
    weight, intercept = np.zeros(len(ratio)), prior
    squares, square = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(STEPS):
        margin = np.bincount(row, value * weight[column], len(features)) + intercept
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - wanted) / len(features)
        slope = np.bincount(column, value * error[row], len(ratio)) + PENALTY * weight
        squares += slope * slope
        square += error.sum() ** 2
        weight -= 0.05 * slope / np.sqrt(squares)
        intercept -= 0.05 * error.sum() / np.sqrt(square)
    return weight, float(intercept)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``, the probability that a text is toxic; null counts as empty."""
    features, weights, intercept = model.features, model.weights, model.intercept

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[features] = True
        for batch in batches:
            texts = batch.fillna("").tolist()
            margin = np.full(len(texts), intercept)
            for begin in range(0, len(texts), 500):
                owner, hashes = presence(texts[begin : begin + 500], wanted)
                margin[begin : begin + 500] += np.bincount(
                    owner, weights[np.searchsorted(features, hashes)], len(texts[begin : begin + 500]))
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -700, 700))))

    return docs.withColumn(out, scored(F.col(f"`{text}`")))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, score, predicted (1 from a score of ``THRESHOLD`` on).

    Labels, languages, sources and keys are no features. Empty texts get the score of a text without
    any feature; repeated rows repeat; an empty table stays empty.
    """
    model = train(docs, labels, key=key, text=text)
    rows = score(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), model, "text")
    return rows.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are."""
    model = train(docs, labels, key=key, text=text)
    whole = score(docs.select(F.struct("*").alias("doc"), F.col(f"`{text}`").alias("text")), model, "text", "_score")
    return whole.where(F.col("_score") < threshold).select("doc.*")
