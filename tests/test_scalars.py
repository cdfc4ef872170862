import math

import pytest
from pyspark.sql import functions as F

from lossgrid.fixed import SENTINELS
from lossgrid.functions import months, scalars
from lossgrid.operators import clean, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, data, schema, column):
    return [r["v"] for r in spark.createDataFrame(data, schema).select(column.alias("v")).collect()]


def test_clip_keeps_missing(spark):
    data = [(None,), (float("nan"),), (-1.0,), (0.4,), (2.0,), (float("inf"),), (float("-inf"),)]
    out = values(spark, data, "x double", scalars.clip("x", 0.0, 1.0))
    assert out[0] is None and math.isnan(out[1]) and out[2:] == [0.0, 0.4, 1.0, 1.0, 0.0]


def test_ratio_limits(spark):
    data = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 2.0)]
    assert values(spark, data, "a double, b double", scalars.realised_ratio("a", "b")) == [
        math.inf, -math.inf, None, 0.25, None,
    ]


def test_status_parse_and_bucket(spark):
    data = [(c,) for c in ["0", "1", "02", "3", "17", "RA", "XX", " 3", "-1", "", None]]
    assert values(spark, data, "s string", scalars.parse_numeric_status("s")) == [0, 1, 2, 3, 17] + [None] * 6
    assert values(spark, data, "s string", scalars.delinquency_bucket("s"))[:6] == [
        "current", "30-59", "60-89", "90-119", "120+", None,
    ]


def test_null_safe_predicates(spark):
    data = [(1,), (None,), (2,)]
    assert values(spark, data, "c int", scalars.is_not("c", 1)) == [False, True, True]
    assert values(spark, data, "c int", scalars.is_in("c", (1,))) == [True, False, False]


def test_stage_default_wins(spark):
    data = [(3, "2"), (None, "2"), (1, "0"), (None, "XX"), (9, "0")]
    assert values(spark, data, "code int, s string", scalars.assign_stage("code", "s")) == [3, 2, 1, 1, 3]


def test_months(spark):
    data = [(202501,), (202412,), (199502,)]
    assert values(spark, data, "m int", months.ym_add("m", -1)) == [202412, 202411, 199501]
    assert values(spark, data, "m int", months.ym_add("m", 12)) == [202601, 202512, 199602]
    assert values(spark, data, "m int", months.date_to_ym(months.ym_to_date("m"))) == [202501, 202412, 199502]


@pytest.mark.parametrize("basis", ["effective_annual", "nominal_monthly"])
def test_lifetime_loss_equals_the_sum(spark, basis):
    rows = [(0.02, 0.4, 1000.0, 5.0, 37), (0.5, 1.0, 10.0, 0.0, 12), (0.0, 0.3, 50.0, 4.0, 20), (0.0, 0.3, 50.0, 0.0, 20)]
    got = values(
        spark, rows, "p double, l double, e double, r double, m int", scalars.ecl_lifetime("p", "l", "e", "r", "m", basis)
    )
    for (p, lgd, ead, r, m), value in zip(rows, got):
        h = 1 - (1 - p) ** (1 / 12)
        df = (lambda t: (1 + r / 100) ** (-t / 12)) if basis == "effective_annual" else (lambda t: (1 + r / 1200) ** -t)
        assert value == pytest.approx(sum(h * (1 - h) ** (t - 1) * lgd * ead * df(t) for t in range(1, m + 1)), abs=1e-9)


def test_sentinel_profiles(spark):
    df = spark.createDataFrame([(9999, 9, 99, "9")], "credit_score int, number_of_units int, number_of_borrowers int, channel string")
    assert tuple(clean.clean_sentinels(df, "train").first()) == (None, 9, None, "9")
    assert tuple(clean.clean_sentinels(df, "score").first()) == (None, None, None, None)
    assert set(SENTINELS) == {"train", "lgd", "score", "unified"}


def test_p_value():
    # published critical values of the correlation coefficient at the 5 % level
    for n, r in ((10, 0.6319), (30, 0.3610), (102, 0.1946)):
        assert metrics.two_sided_p_value(r, n) == pytest.approx(0.05, abs=2e-4)
    assert metrics.two_sided_p_value(0.0, 50) == pytest.approx(1.0)
    assert metrics.two_sided_p_value(None, 50) is None and metrics.two_sided_p_value(1.0, 50) == 0.0


def test_log_odds_round_trip(spark):
    assert one(spark, scalars.from_log_odds(scalars.log_odds(F.lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, scalars.log_odds(F.lit(0.0))) == pytest.approx(math.log(1e-15))
