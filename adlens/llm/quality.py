"""Quality by compression: a text resembles the texts whose dictionary compresses it better.

Two zstandard dictionaries are built from blocks of good and of bad labelled texts. A text is cut
into blocks, each compressed with both; the difference of the sizes over their sum is calibrated to
a probability on labelled rows that built neither dictionary. Blocks are short, so that a text's own
repetitions do not hide what the dictionary knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.labelled import held_out, training_rows

#: Labelled rows of each kind a dictionary is built from, blocks taken of each, rows that calibrate.
DICTIONARY_ROWS, BLOCKS, CALIBRATION_ROWS = 1_500, 6, 6_000
#: Rows of the sample both come from, dictionary size, block size, level, threshold.
TRAIN_ROWS, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL, THRESHOLD = 24_000, 65_536, 1_024, 6, 0.7


@dataclass
class Model:
    """Both dictionaries and the line that turns a size difference into log odds."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


def _difference(text: str, good, bad) -> float:
    blocks = _blocks(text.encode())
    with_good = sum(len(good.compress(b)) for b in blocks)
    with_bad = sum(len(bad.compress(b)) for b in blocks)
    return (with_bad - with_good) / (with_bad + with_good)


def with_difference(docs: DataFrame, good: bytes, bad: bytes, text: str, out: str) -> DataFrame:
    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, b = _compressor(good), _compressor(bad)
        for batch in batches:
            yield batch.fillna("").map(lambda t: _difference(t, a, b)).astype("float64")

    return docs.withColumn(out, difference(F.col(f"`{text}`")))


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary of blocks spread evenly over each text; none where there is too little text."""
    import zstandard

    samples = []
    for text in texts:
        blocks = _blocks(text.encode())
        samples += [blocks[i] for i in sorted({int(x) for x in np.linspace(0, len(blocks) - 1, BLOCKS)})]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 2), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def blocks(text: str) -> Column:
    """The blocks a dictionary can use, whatever the length of a text: all of a short one, else evenly
    spread ones, the last of which ends with the text."""
    length = F.length(text)
    apart = (length - BLOCK_BYTES) / (BLOCKS - 1)

    def block(i: Column) -> Column:
        begin = F.when(length <= BLOCKS * BLOCK_BYTES, i * BLOCK_BYTES).otherwise(F.floor(i * apart))
        return F.substr(text, (begin + 1).cast("int"), F.lit(BLOCK_BYTES))

    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS,
          key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out part.

    A third of the sample, by a hash of the key, builds the dictionaries; at most
    ``CALIBRATION_ROWS`` of the rest calibrate. Only the blocks of ``DICTIONARY_ROWS`` texts of each
    kind and one number per calibrating row reach the driver. Without rows of a kind every text
    scores the smoothed share of good rows.
    """
    sample = training_rows(docs, labels, label, rows, key, text)
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(3))
    pieces = blocks("text")
    texts = []
    for good in (True, False):
        chosen = (
            sample.where((part == 0) & ((F.col("label") > 0.5) == good)).select("key", pieces.alias("pieces"))
            .orderBy(F.xxhash64("key"), "key").limit(DICTIONARY_ROWS)
        )
        texts.append(["".join(r.pieces) for r in chosen.toLocalIterator()])
    good, bad = (_dictionary(t) for t in texts)
    rows_ = sample.where(part != 0).orderBy(F.xxhash64("key"), "key").limit(CALIBRATION_ROWS)
    measured = with_difference(rows_, good, bad, "text", "x").select("label", "x").toPandas()
    wanted, x = (measured["label"].to_numpy() > 0.5).astype(float), measured["x"].to_numpy()
    slope, intercept = _calibrate(x, wanted)
    return Model(good, bad, slope, intercept)


def _calibrate(x: np.ndarray, wanted: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's steps, with a weak pull to zero."""
    prior = float(np.log((wanted.sum() + 0.5) / ((1 - wanted).sum() + 0.5)))
    if not len(x) or wanted.min() == wanted.max() or np.ptp(x) == 0:
        return 0.0, prior
    scale = float(x.std())
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.array([0.0, prior])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ weight, -30, 30)))
        curve = design.T @ (design * (chance * (1 - chance))[:, None]) + 1e-3 * np.eye(2)
        weight -= np.linalg.solve(curve, design.T @ (chance - wanted) + 1e-3 * weight)
    return float(max(0.0, weight[0]) / scale), float(weight[1])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality; null counts as empty text."""
    measured = with_difference(docs, model.good, model.bad, text, "_difference")
    odds = F.col("_difference") * model.slope + model.intercept
    return measured.withColumn(out, 1 / (1 + F.exp(-odds))).drop("_difference")


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, score, predicted (1 from a score of ``THRESHOLD`` on).

    Labels, languages, sources and keys play no part in a score. Whole texts are compressed, block
    by block; empty ones score what their one empty block gives. Repeated rows repeat; an empty
    table stays empty.
    """
    model = train(docs, labels, key=key, text=text)
    rows = score(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), model, "text")
    return rows.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
