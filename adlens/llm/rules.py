"""Quality rules learnt as a decision list.

Statistics of every text are worked out on Spark. From a bounded sample of labelled rows sequential
covering learns ordered rules: a rule grows condition by condition (statistic below or above a
threshold) by the information it gains on one part of the sample, is pruned on the other, and what
it covers is taken away before the next. The list becomes one ordered Spark expression of ``when``
conditions, so that the verdict on the whole corpus is plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.labelled import training_rows

#: Labelled rows learnt from at most, rules at most, conditions of a rule at most, thresholds tried
#: per statistic, share of bad rows that a rule must reach on the pruning part, rows it must cover.
TRAIN_ROWS, RULES, CONDITIONS, THRESHOLDS, PRECISION, COVERED = 20_000, 24, 4, 64, 0.8, 5
#: The base rule: fewer words than this, or more than this share in percent of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
           "n_upper", "n_marks", "n_digits", "n_bars", "n_different")
#: Ratios that rules may use, as numerator and denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"), "bars_per_word": ("n_bars", "n_words"),
    "different_share": ("n_different", "n_words"),
}
STATISTICS = (*RATIOS, "n_words", "n_dup_lines")


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, until)
            until = at + 3
    return covered


#: Fixed characters that are counted.
_BLANK, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _number(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def _counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # of bytes: ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.split()]
    return (
        len(words), len(text) - _number(raw, _BLANK), _number(raw, _SYMBOLS), len(lines) - len(set(lines)),
        _repeat_words(words), len(text), len(lines), _number(raw, _UPPER), _number(raw, b"!?"),
        _number(raw, b"0123456789"), raw.count(b"|"), len(set(words)),
    )


def statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of counts of the whole text; a null text has none of anything."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_counts(t or "") for t in batch], columns=list(_COUNTS), dtype="int64")

    return docs.withColumn(out, counted(F.col(f"`{text}`")))


def _with_ratios(rows: DataFrame, stats: str) -> DataFrame:
    """``rows`` with the counts and ratios as columns of their own struct; nothing divided by zero."""
    ratios = [
        (F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1))).alias(name) for name, (a, b) in RATIOS.items()
    ]
    return rows.withColumn(stats, F.struct(f"{stats}.*", *ratios))


# ---- learning


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        value = values[self.statistic]
        return value >= self.threshold if self.above else value < self.threshold

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.statistic}")
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], rows: int) -> np.ndarray:
    covered = np.ones(rows, bool)
    for condition in rule:
        covered &= condition.holds(values)
    return covered


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> Rule:
    """Conditions added by the information gained about bad rows, until none is wrongly covered."""
    rule: Rule = ()
    inside = live.copy()
    for _ in range(CONDITIONS):
        hits, misses = int((bad & inside).sum()), int((~bad & inside).sum())
        if not hits or not misses:
            break
        base, best, chosen = np.log2(hits / (hits + misses)), 1e-9, None
        for name in STATISTICS:
            value = values[name][inside]
            order = np.argsort(value, kind="stable")
            value, wrong = value[order], bad[inside][order]
            cuts = np.unique(value[np.linspace(0, len(value) - 1, THRESHOLDS).astype(int)])
            place = np.searchsorted(value, cuts, side="left")
            below = np.r_[0, np.cumsum(wrong)][place]
            for above, p, n in ((True, hits - below, len(value) - place), (False, below, place)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - base), 0)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, chosen = gain[at], Condition(name, above, float(cuts[at]))
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is worth most on the pruning part; its share of bad rows."""
    best = ((), -np.inf, 0.0, 0)
    for end in range(1, len(rule) + 1):
        covered = _covers(rule[:end], values, len(bad)) & live
        p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        worth = (p - n) / (p + n + 1)
        if worth > best[1]:
            best = (rule[:end], worth, p / max(1, p + n), p + n)
    return best[0], best[2], best[3]


def learn(sample: pd.DataFrame) -> list[Rule]:
    """An ordered list of rules that name bad rows; ``sample`` has the statistics and ``good``."""
    rules: list[Rule] = []
    if sample.empty or sample["good"].all() or not sample["good"].any():
        return rules
    bad = ~sample["good"].to_numpy(bool)
    values = {name: sample[name].to_numpy(float) for name in STATISTICS}
    growing = np.arange(len(bad)) % 3 != 2
    live = np.ones(len(bad), bool)
    while len(rules) < RULES:
        rule = _grow(values, bad, live & growing)
        if not rule:
            break
        rule, precision, rows = _prune(rule, values, bad, live & ~growing)
        covered = _covers(rule, values, len(bad)) & live
        if not rule or precision < PRECISION or rows < min(COVERED, max(1, len(bad) // 200)):
            break
        rules.append(rule)
        live &= ~covered
    return rules


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS,
          key: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learn from at most ``rows`` labelled rows outside the held-out part that pass the base rule.

    Only their statistics reach the driver. Without labels of both kinds the list is empty.
    """
    sample = _with_ratios(statistics(training_rows(docs, labels, label, rows, key, text)), "stats")
    sample = sample.where(~base_failed("stats")).select("key", (F.col("label") > 0.5).alias("good"), *(f"stats.{s}" for s in STATISTICS))
    return learn(sample.toPandas().sort_values(["key"], kind="stable").reset_index(drop=True))


# ---- verdicts


def base_failed(stats: str) -> Column:
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The list as ordered conditions: the first rule that holds says no, else yes."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        holds = rule[0].column(stats)
        for condition in rule[1:]:
            holds = holds & condition.column(stats)
        chain = F.when(holds, False) if chain is None else chain.when(holds, False)
    return chain.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    A null text has no words and fails the base rule. Rows that fail it are not kept, whatever the
    rules say. Repeated rows repeat; an empty table stays empty.
    """
    rules = train(docs, labels, key=key, text=text)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = _with_ratios(statistics(rows), "stats")
    return rows.select(
        F.col("key").alias(key), *(F.col(f"stats.{c}").alias(c) for c in _COUNTS[:5]),
        base_failed("stats").alias("base_failed"),
        F.when(base_failed("stats"), False).otherwise(verdict(rules)).alias("kept"),
    )
