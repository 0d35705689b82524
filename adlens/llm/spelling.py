"""Groups of spelling variants by permuterm rotations.

Every rotation of a word with a terminator behind it stands in a sorted table. A word cut at a place
into ``a x b`` has the rotation ``b $ a x``: all words that differ in x only share the prefix
``b $ a``, and the word without x *is* that prefix, as a whole rotation. Sorted by the prefix, words
at one replacement, insertion or deletion of each other stand side by side. A group has one free
character, so it has at most as many members as the alphabet of runs has characters, plus one; it is
scanned in order, and each member takes the number and the best of its neighbours from it.

An insertion into a run of equal characters is the same word at every place of the run. Only the
last place counts, so each pair of words meets exactly once and numbers can be added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.operators.spread import attach
from adlens.session import durable

#: Runs of letters (fixed pattern) and the character that ends a word; no run holds it.
RUN, END = r"[A-Za-zÀ-ÿ]+", "$"
#: A run whose hash this number divides loses a character.
LOSES = 199
#: Fewest characters and occurrences of a word, and how much more frequent its form must be.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words a task counts before it hands them on, characters of a text that are split at a time.
HELD, PIECE = 400_000, 1 << 20

_RUN = re.compile(RUN)


# ---- words


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, of which only A-Z are lower-cased, piece by piece."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and _RUN.match(text[end]):  # a run is never cut
            end += 1
        yield _RUN.findall(text[begin:end].encode().lower().decode())
        begin = end


def _lossy(key: str, run: str) -> str:
    h = crc32(f"{key}:{run}".encode())
    if h % LOSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
          least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all runs of all texts, some without one character by the hash of key and run.

    Tasks count what they read and hand on partial counts before their table grows beyond ``HELD``
    words, so no text, key or word is ever gathered. A null text has no runs, a null key is empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush():
            columns = [pa.array(held, pa.string(), size=len(held)), pa.array(held.values(), pa.int64(), size=len(held))]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                name = name or ""
                for runs in _runs(value or ""):
                    for run, n in Counter(runs).items():
                        if len(run) >= least_chars and len(word := _lossy(name, run)) >= least_chars:
                            held[word] += n
                    if len(held) > HELD:
                        yield flush()
                        held.clear()
        yield flush()

    texts = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    counted = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


# ---- rotations


def rotations(known: DataFrame) -> DataFrame:
    """(prefix, word, n, cut, last): whole rotations, and rotations without the character x at their end.

    ``cut`` tells the two apart; ``last`` is false where the next character is x again, so that the
    same shorter word also comes from a later place.
    """
    word, size, at = F.col("word"), F.length("word"), F.col("at")
    places = known.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    before, x, behind = word.substr(F.lit(1), at), word.substr(at + 1, F.lit(1)), word.substr(at + 2, size)
    whole = places.select(
        F.concat(word.substr(at + 1, size), F.lit(END), before).alias("prefix"), "word", "n",
        F.lit(False).alias("cut"), F.lit(True).alias("last"))
    skipped = places.where(at < size).select(
        F.concat(behind, F.lit(END), before).alias("prefix"), "word", "n",
        F.lit(True).alias("cut"), (x != behind.substr(F.lit(1), F.lit(1))).alias("last"))
    return whole.unionByName(skipped)


def _rank(word: str = "word", n: str = "n") -> Column:
    """Smaller is better: the larger count, then the smaller word in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def neighbours(known: DataFrame) -> DataFrame:
    """(word, near, best): per word and group, how many words are one edit away and the best of them.

    The table of rotations is sorted by prefix across the cluster; each group lies in one task, is
    read in order of rank and gives at most one row per member, not one per pair.
    """
    table = rotations(known)
    sorted_table = table.repartitionByRange("prefix").withColumn("rank", _rank())
    group = Window.partitionBy("prefix").orderBy("rank")
    scan = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut, last = F.col("cut"), F.col("cut") & F.col("last")
    in_cut, in_last = F.when(cut, F.col("rank")), F.when(last, F.col("rank"))
    seen = sorted_table.withColumns({
        "members": F.count(F.lit(1)).over(scan),
        "cuts": F.count(F.when(cut, 1)).over(scan),
        "lasts": F.count(F.when(last, 1)).over(scan),
        "first_cut": F.first(in_cut, ignorenulls=True).over(scan),
        "second_cut": F.nth_value(in_cut, 2, ignoreNulls=True).over(scan),
        "first_last": F.first(in_last, ignorenulls=True).over(scan),
        "whole": F.first(F.when(~cut, F.col("rank")), ignorenulls=True).over(scan),
    }).where("members > 1")
    other = F.when(F.col("first_cut") == F.col("rank"), F.col("second_cut")).otherwise(F.col("first_cut"))
    shorter = F.when(last, F.col("whole"))
    return seen.select(
        "word",
        F.when(cut, F.col("cuts") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("lasts")).alias("near"),
        F.when(cut, F.least(other, shorter)).otherwise(F.col("first_last")).alias("best"),
    ).where("near > 0")


# ---- the operator


def _rooted(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled, ``steps`` times."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(steps):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = durable(attach(roots, on, ["root"], by=["word"]).select("word", F.coalesce("next", "root").alias("root")))
    return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. The
    form of a word is its most frequent near word (ties: the smallest in code-point order) if that
    occurs ``ratio`` times as often or more, else null; the root follows forms to the last. Null
    texts have no words, null keys count as empty, repeated rows count each; no words, no rows.
    Other columns play no part.

    Counts grow by ``ratio`` (two or more) along forms, so no chain has more steps than the largest
    count allows; that bounds the rounds of pointer doubling.
    """
    if ratio < 2 or least_count < 1:
        raise ValueError("ratio is at least 2, least_count at least 1")
    known = durable(words(docs, key, text, least_chars, least_count))
    none = known.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    found = neighbours(known).select("word", F.lit(None).cast("bigint").alias("n"), F.col("near").cast("bigint"), "best")
    merged = none.unionByName(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    formed = durable(merged.select(
        "word", F.when(taken, F.col("best.word")).alias("form"), "n", "n_near",
        F.when(taken, -F.col("best.less")).alias("form_n")))
    largest = known.agg(F.max("n")).first()[0] or 0
    reach, steps = least_count * ratio, 0  # a chain of one form
    while reach < largest:
        steps, reach = steps + 1, least_count * ratio ** (2 ** (steps + 1))
    roots = _rooted(formed.where("form is not null"), steps)
    return attach(formed, roots, ["word"], by=["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
