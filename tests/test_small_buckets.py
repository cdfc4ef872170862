"""Every SQL twin again with buckets of a few hundred rows and hot loans of a few dozen: the paths of large tables."""

import numpy as np
import pytest
from compare import connect, difference

from lossgrid.operators import order, skew
from lossgrid.plans import proxy
from lossgrid.plans.oracles import ORACLES
from lossgrid.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    settings = {"lossgrid.rowsPerBucket": "300", "lossgrid.rowsPerTask": "10"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


def test_loans_are_hot_under_these_settings(small):
    hot = skew.hot_keys(proxy.performance(small, SF), "loan_identifier")
    assert hot.count() > 100
    assert hot.where("_salts > 1").count() == hot.count()


# fits with many small jobs, whose order-based parts the other queries cover, and storage, which has no such parts
SLOW = {"feature_vectors", "pd_model_lr_equations", "saved_models"}
SLOW |= {"stored_performance", "stored_stage", "stored_csv", "declared_tables"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(REGISTRY) - SLOW))
def test_twin(small, name):
    assert difference(REGISTRY[name](small, SF), connect(SF), ORACLES[name]) is None


def test_buckets_need_two_levels(small, monkeypatch):
    monkeypatch.setattr(order, "SKETCH_CUTS", 4)
    df = small.range(20_000).selectExpr("cast(pmod(id * 7919, 20011) as double) AS x", "id % 3 AS g")
    heavy = df.unionByName(small.range(9_000).selectExpr("5000D AS x", "0L AS g"))
    cuts = order.fit_cuts(heavy, ["x"], 300)["x"]
    sizes = {
        r["_bucket"]: r["count"] for r in order.with_bucket(heavy, "x", cuts).groupBy("_bucket").count().collect()
    }
    light = [n for b, n in sizes.items() if b not in cuts.heavy_buckets]
    assert 5000.0 in cuts.heavy and max(light) <= 600 and len(sizes) > 45
    found = order.exact_quantiles(heavy, {"x": [0.1, 0.5]}, 300)["x"]
    values = np.array([r["x"] for r in heavy.select("x").collect()])
    assert np.allclose(found, np.quantile(values, [0.1, 0.5]))
