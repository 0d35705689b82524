import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, fp long, kept string, score double, `_key` int, doc string"


def table(spark, rows):
    """Documents with extra columns whose names are used inside the operators too."""
    return spark.createDataFrame(
        [(i, t, "en", None, None if t is None else len(t), "k", 1, "x", 0.5, 3, "d") for i, t in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 131}" for i in range(30_000))
SHARED = "this passage of well over fifty bytes stands in several of the documents here "
ODD = [
    (1, "A b  c\td"), (2, "A b c d"), (2, "A b c d"), (3, None), (4, ""), (None, "A b c d"), (5, " \n\t "),
    (6, LONG), (7, LONG), (8, "é漢🙂 ▁ </s>"), (9, "x"), (None, None), (10, "Start " + SHARED + "one end"),
    (11, "Other " + SHARED + "two end"), (12, "a" * 300), (13, "a" * 120), (14, "\x00" * 130), (15, "ab\n" * 90),
]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, (i // 3) % 2, i % 2) for i in range(400)] + [(None, 1, 1), (3, None, None), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def tables(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")
