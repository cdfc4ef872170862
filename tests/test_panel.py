import random

import pytest
from pyspark.sql import functions as F

from lossgrid.operators import panel, sampling, severity
from lossgrid.operators.skew import hot_keys, previous_value, salted_join

PERF = "loan_identifier string, monthly_reporting_period int, zero_balance_code int, record_id long"


def months_of(ym):
    return ym // 100 * 12 + ym % 100 - 1


def to_ym(i):
    return i // 12 * 100 + i % 12 + 1


@pytest.fixture(scope="module")
def rows():
    """One loan holds a third of all rows; loans default several times and report months twice."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        loan = "hot" if i % 3 == 0 else f"L{rng.randrange(60)}"
        code = rng.choice([None, None, None, None, 1, 2, 3, 9])
        out.append((loan, to_ym(months_of(202001) + rng.randrange(50)), code, i))
    return out


@pytest.fixture(scope="module")
def perf(spark, rows):
    return spark.createDataFrame(rows, PERF)


def test_label_window(spark):
    data = [("a", m, None, i) for i, m in enumerate([202311, 202312, 202412, 202501])] + [("a", 202501, 2, 9)]
    df = spark.createDataFrame(data, PERF)
    out = panel.label_panel(df, panel.default_events(df), cutoff=202512)
    labels = {r["observation_month"]: r["default_12m"] for r in out.collect()}
    # thirteen and fourteen months ahead are out, one month ahead is in, the month itself is gone
    assert labels == {202311: 0, 202312: 0, 202412: 1}
    exactly = panel.label_panel(
        spark.createDataFrame([("b", 202401, None, 1), ("b", 202501, 9, 2)], PERF), panel.default_events(
            spark.createDataFrame([("b", 202501, 9, 2)], PERF)), cutoff=202512)
    assert [r["default_12m"] for r in exactly.collect()] == [1]


def hot_table(perf, keys):
    """The keys with five salts each."""
    if not keys:
        return None
    return perf.sparkSession.createDataFrame([(k, 5) for k in keys], "loan_identifier string, _salts long")


@pytest.mark.parametrize("hot", [(), ("hot", "L1")])
def test_first_event_policy(perf, rows, hot):
    first = {}
    for loan, m, code, _ in rows:
        if code in (2, 3, 9):
            first[loan] = min(first.get(loan, m), m)
    expected = sorted(
        (i, int(loan in first and 0 < months_of(first[loan]) - months_of(m) <= 12))
        for loan, m, _, i in rows
        if m <= 202306 and (loan not in first or m < first[loan])
    )
    out = panel.label_panel(perf, panel.default_events(perf), cutoff=202306, hot=hot_table(perf, hot))
    assert sorted((r["record_id"], r["default_12m"]) for r in out.collect()) == expected


@pytest.mark.parametrize("hot", [(), ("hot", "L1")])
def test_all_events_policy_counts_every_copy(perf, rows, hot):
    events = {}
    for loan, m, code, _ in rows:
        if code in (2, 3, 9):
            events.setdefault(loan, []).append(m)
    expected = {}
    for loan, m, _, i in rows:
        if m > 202306:
            continue
        for d in events.get(loan, [None]):
            if d is None or m < d:
                label = int(d is not None and months_of(d) - months_of(m) <= 12)
                expected[(i, label)] = expected.get((i, label), 0) + 1
    out = panel.label_panel(perf, panel.default_events(perf), cutoff=202306, policy="all", hot=hot_table(perf, hot))
    assert {(r["record_id"], r["default_12m"]): r["copies"] for r in out.collect()} == expected


def test_label_grows_with_the_horizon(perf):
    events = panel.default_events(perf)
    total = [
        panel.label_panel(perf, events, horizon=h, cutoff=None).agg(F.sum("default_12m")).first()[0] for h in (3, 12, 24)
    ]
    assert total == sorted(total) and total[0] < total[2]


def test_hot_keys_and_salted_join(spark, perf):
    n = perf.where("loan_identifier = 'hot'").count()
    found = {r["loan_identifier"]: r["_salts"] for r in hot_keys(perf, "loan_identifier", n // 3).collect()}
    assert found["hot"] >= 3 and set(found) == {"hot"}
    assert hot_keys(perf, "loan_identifier") is None
    assert hot_keys(perf, "loan_identifier", n * 10) is None
    right = perf.select("loan_identifier").distinct().where("loan_identifier <> 'L3'").withColumn("x", F.length("loan_identifier"))
    for how in ("inner", "left", "left_semi"):
        plain = perf.join(right, "loan_identifier", how)
        salted = salted_join(perf, right, "loan_identifier", how, hot_table(perf, ("hot", "L1")))
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_previous_value_of_hot_keys(perf):
    order = ["monthly_reporting_period", "record_id"]
    columns = ["zero_balance_code", "record_id"]
    plain = previous_value(perf, "loan_identifier", order, columns)
    cut = previous_value(perf, "loan_identifier", order, columns, hot=hot_table(perf, ("hot", "L1")), rows_per_bucket=20)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_observation_tag_over_new_year(spark):
    df = spark.createDataFrame([(202412, 202501), (202501, 202501), (202411, 202501)], "m int, d int")
    assert [r[0] for r in df.select(severity.observation_tag("m", "d")).collect()] == [
        "1_month_before", "default_month", None,
    ]


def test_splits_are_disjoint():
    sampling.check_disjoint(sampling.PD_SPLIT)
    sampling.check_disjoint(sampling.LGD_SPLIT)
    sampling.check_disjoint(sampling.PD_REESTIMATION_SPLIT)
    with pytest.raises(ValueError):
        sampling.check_disjoint({"train": (None, 2023), "validation": (2022, 2023)})


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = sampling.stratified_sample(df, "y", 1234, ["id"])
    b = sampling.stratified_sample(df.repartition(7), "y", 1234, ["id"])
    rows = a.collect()
    assert len(rows) == 1234 and abs(sum(r["y"] for r in rows) - 123.4) < 1
    assert sorted(rows) == sorted(b.collect())
    assert sampling.stratified_sample(df, "y", 9999, ["id"]).count() == 5000
