"""Cleaning of random dirty files against a plain reading of the rules, row by row."""

import csv
import datetime
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from adlens.functions.text import canonical_channel
from adlens.operators import cleaning as cl
from adlens.schema import MEASURES, NA_TOKENS
from adlens.sources.files import read_campaign_csv

from conftest import records

NUMBERS = ["0", "5", "12.50", "-3", "1e2", ".5", "7.", " 8 ", "+4", "100000", "-0.25"]
TEXTS = ["$1,200.75", "-$5", "(50)", "abc", "1.2.3", "5d", "0x1f", "12%", "EUR 7", "1,000", "--"]
MISSING = ["", "NA", "N/A", "null", "NaN", "None", "nan", "-1.#IND"]
CHANNELS = ["google ads", " GOOGLE ADS ", "o'neil", "web2go", "", "NA", "tikTok-ads", "été À"]
DATES = ["2026-01-01", "2026-1-2", "2026-01-03", "03/01/2026", "soon", "", "2026-02-30"]
PLAIN = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", re.IGNORECASE)


def value_of(token, as_text):
    """(value or None, was negative) of one cell."""
    if token in NA_TOKENS:
        return None, False
    if as_text:
        digits = re.sub(r"[^0-9.]", "", token)
        return (float(digits), False) if PLAIN.fullmatch(digits) else (None, False)
    number = float(token)
    return max(number, 0.0), number < 0


def expected(rows):
    text = {c: any(r[c] not in NA_TOKENS and not PLAIN.fullmatch(r[c]) for r in rows)
            for c in MEASURES}
    counts = {("loaded", ""): len(rows), ("bad_date", "Date"): 0}
    for c in MEASURES:
        counts[("null", c)] = counts[("negative", c)] = 0
    days = {}
    for r in rows:
        try:
            date = datetime.datetime.strptime(r["Date"], "%Y-%m-%d").date()
        except ValueError:
            counts[("bad_date", "Date")] += 1
            continue
        name = ("nan" if r["Channel"] in NA_TOKENS else r["Channel"]).strip().title()
        sums = days.setdefault((date, name), [0, *[0.0] * 5])
        sums[0] += 1
        for i, c in enumerate(MEASURES, 1):
            value, negative = value_of(r[c], text[c])
            counts[("null", c)] += value is None
            counts[("negative", c)] += negative
            sums[i] += value or 0.0
    counts[("duplicate", "")] = sum(n - 1 for n, *_ in days.values())
    counts[("final", "")] = len(days)
    return {k: v[1:] for k, v in days.items()}, counts


def test_random_files(spark, tmp_path):
    rng = random.Random(20)
    files = {}
    for i in range(12):
        pools = {c: NUMBERS + MISSING + (TEXTS if rng.random() < 0.4 else []) for c in MEASURES}
        files[f"f{i}"] = [
            {"Date": rng.choice(DATES), "Channel": rng.choice(CHANNELS),
             **{c: rng.choice(pools[c]) for c in MEASURES}}
            for _ in range(rng.randrange(1, 60))
        ]
    for name, rows in files.items():
        out = io.StringIO()
        writer = csv.DictWriter(out, ["Date", "Channel", *MEASURES])
        writer.writeheader()
        writer.writerows(rows)
        (tmp_path / f"{name}.csv").write_text(out.getvalue())
    raw = read_campaign_csv(spark, str(tmp_path))
    facts, audit = {}, {}
    for r in records(cl.clean(raw)):
        facts.setdefault(r["campaign_id"], {})[(r["Date"], r["Channel"])] = [r[c] for c in MEASURES]
    for r in records(cl.cleaning_audit(raw)):
        audit.setdefault(r["campaign_id"], {})[(r["step"], r["column"])] = r["n_rows"]
    for name, rows in files.items():
        days, counts = expected(rows)
        assert audit[name] == counts
        got = facts.get(name, {})
        assert set(got) == set(days)
        for key, sums in days.items():
            assert got[key] == [pytest.approx(v) for v in sums]


def test_random_names(spark):
    rng = random.Random(21)
    letters = "aBcXyZéÜñçøÅжЯ中文 \t'-_.19&"
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(800)}
    names = sorted(n for n in names if n not in NA_TOKENS)
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", canonical_channel(F.col("n")).alias("c"))
    assert {r["n"]: r["c"] for r in got.collect()} == {n: n.strip().title() for n in names}
