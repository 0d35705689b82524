import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adlens.schema import FACT_SCHEMA  # noqa: E402
from adlens.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "adlens-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Ten days of two channels; impressions, clicks, conversions and revenue per day.
GOOGLE = [
    (150, 3000, 120, 4.8, 600), (160, 3200, 130, 5.2, 650), (140, 2800, 110, 4.4, 590),
    (155, 3100, 125, 5.0, 620), (180, 3600, 150, 6.0, 750), (130, 2600, 100, 4.0, 500),
    (135, 2700, 105, 4.2, 520), (150, 3000, 120, 4.8, 610), (165, 3300, 135, 5.4, 670),
    (170, 3400, 140, 5.6, 700),
]
META = [
    (200, 5000, 180, 6.3, 550), (210, 5200, 190, 6.6, 580), (195, 4900, 175, 6.1, 530),
    (205, 5100, 185, 6.5, 570), (250, 6000, 220, 7.7, 680), (170, 4200, 140, 4.9, 430),
    (175, 4300, 145, 5.1, 450), (200, 5000, 180, 6.3, 560), (220, 5500, 200, 7.0, 610),
    (230, 5800, 210, 7.35, 640),
]


def sample_rows():
    start = datetime.date(2026, 6, 1)
    return [
        ("sample", start + datetime.timedelta(days=i), name, *map(float, day))
        for i in range(10)
        for name, days in (("Google Ads", GOOGLE), ("Meta Ads", META))
        for day in [days[i]]
    ]


@pytest.fixture(scope="session")
def sample(spark):
    return spark.createDataFrame(sample_rows(), FACT_SCHEMA)


def records(df, *by):
    return [row.asDict() for row in (df.orderBy(*by) if by else df).collect()]
