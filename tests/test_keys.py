"""Operators under other leading columns give the same figures as under campaign_id."""

import pytest
from pyspark.sql import functions as F

from adlens.operators import cleaning as cl, diagnose as dx, features as ft, forecast as fc
from adlens.operators import narrative as nv, response as rc, summary as sm
from adlens.operators.cleaning import MEASURES

from conftest import records

KEYS = ("region", "shop")


def same(one_key, two_keys, *by):
    left = records(one_key, "campaign_id", *by)
    right = records(two_keys.withColumn("campaign_id", F.concat_ws("/", *KEYS)).drop(*KEYS),
                    "campaign_id", *by)
    assert len(left) == len(right) > 0
    for a, b in zip(left, right):
        assert set(a) == set(b)
        for name, value in a.items():
            assert b[name] == (pytest.approx(value) if isinstance(value, float) else value)


@pytest.fixture(scope="module")
def tables(spark, sample):
    wide = sample.withColumn("region", F.lit("eu")).unionByName(
        sample.withColumn("region", F.lit("us")).withColumn("Spend", F.col("Spend") * 2))
    wide = wide.withColumn("shop", F.lit("s")).drop("campaign_id").cache()
    return wide.withColumn("campaign_id", F.concat_ws("/", *KEYS)).drop(*KEYS), wide


def test_cleaning(tables):
    one, two = (
        t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]) for t in tables)
    same(cl.clean(one), cl.clean(two, KEYS), "Date", "Channel")
    same(cl.clean_numeric(one), cl.clean_numeric(two, KEYS), "Date", "Channel")
    same(cl.cleaning_audit(one), cl.cleaning_audit(two, KEYS), "step", "column")
    same(cl.duplicate_count(one), cl.duplicate_count(two, KEYS))
    assert cl.clean(two, KEYS).columns == [*KEYS, "Date", "Channel", *MEASURES]


def test_summaries_and_forecast(tables):
    one, two = tables
    a, b = ft.engineer_features(one), ft.engineer_features(two, KEYS)
    same(a, b, "Date", "Channel")
    x, y = fc.forecast(a, 5).cache(), fc.forecast(b, 5, keys=KEYS).cache()
    same(x, y, "Date", "Channel")
    same(sm.forecast_summary(x), sm.forecast_summary(y, keys=KEYS))
    same(sm.last_n_dates(one, 3), sm.last_n_dates(two, 3, KEYS), "Date", "Channel")
    same(sm.channel_contribution(x), sm.channel_contribution(y, KEYS), "Channel")
    p, q = sm.channel_summary(x), sm.channel_summary(y, KEYS)
    r, s = sm.rank_channels(p), sm.rank_channels(q, KEYS)
    same(r, s, "rank")
    u, v = sm.forecast_summary(x), sm.forecast_summary(y, keys=KEYS)
    same(dx.risk_flags(u, p), dx.risk_flags(v, q, KEYS))
    same(nv.narrative(u, r), nv.narrative(v, s, keys=KEYS), "section", "line")


def test_response(tables):
    one, two = tables
    a, b = rc.fit_curves(one), rc.fit_curves(two, KEYS)
    same(a, b, "Channel")
    same(rc.baseline(a), rc.baseline(b, KEYS), "Channel")
    same(rc.optimize(a, rc.default_total(a)), rc.optimize(b, rc.default_total(b, KEYS), KEYS),
         "Channel")
    split_a = rc.split_as_budgets(rc.optimize(a, rc.default_total(a)))
    split_b = rc.split_as_budgets(rc.optimize(b, rc.default_total(b, KEYS), KEYS), keys=KEYS)
    same(rc.simulate(a, split_a), rc.simulate(b, split_b, KEYS), "Channel")
    same(rc.totals_of_budgets(a, split_a), rc.totals_of_budgets(b, split_b, KEYS))
    same(rc.budget_grid(a), rc.budget_grid(b, KEYS), "Channel", "budget")


class _Session:
    """The settings of a session, without one."""

    def __init__(self, master, **settings):
        self.sparkContext = self
        self.conf, self.master, self.settings = self, master, settings

    def getCheckpointDir(self):
        return None

    def get(self, name, default=None):
        return self.settings.get(name.replace(".", "_"), default)


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    import pytest

    from adlens.session import shared_folder

    own = {"spark_sql_warehouse_dir": "file:/home/x/spark-warehouse"}
    assert shared_folder(_Session("local[4]", **own)) == "file:/home/x/spark-warehouse/_adlens"
    assert shared_folder(_Session("yarn", spark_sql_warehouse_dir="hdfs://n/w/")) == "hdfs://n/w/_adlens"
    assert shared_folder(_Session("yarn", **own, spark_checkpoint_dir="hdfs://n/c")) == "hdfs://n/c"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(_Session("spark://n:7077", **own))
