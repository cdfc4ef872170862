"""Rules that the SQL twins do not reach: missing labels, failing reads, weights, convergence, p-values, plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgrid.operators import binning, calibration, ecl, metrics, models, panel, sampling, skew
from lossgrid.operators.features import fit_modes
from lossgrid.plans import proxy
from lossgrid.sources import tables
from lossgrid.sources.stages import StageCatalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [10**6, 50])
def test_rows_without_a_label_count_nowhere(spark, size):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": range(1000), "p": np.round(rng.random(1000), 2), "y": rng.integers(0, 2, 1000)})
    rows = [(int(i), float(p), None if i % 4 == 0 else int(y)) for i, p, y in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    known = frame[frame.id % 4 != 0]
    got = {r["top_percent"]: r for r in binning.capture_lift(df, "p", "y", ["id"], rows_per_bucket=size).collect()}
    assert got[50]["observations"] == len(known) // 2 and got[50]["total_defaults"] == known.y.sum()
    best = known.sort_values("p", ascending=False)
    sure = best[best.p > best.p.iloc[len(known) // 2 - 1]].y.sum()
    assert sure <= got[50]["defaults_captured"] <= known.y.sum()
    assert metrics.classification_metrics(df, "p", "y").first()["observations"] == len(known)
    empty = binning.capture_lift(df.where("false"), "p", "y", ["id"]).collect()
    assert {r["defaults_captured"] for r in empty} == {0}


def test_bad_values_fail_the_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nx,3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int").collect()


def test_text_is_trimmed_from_every_format(spark, tmp_path):
    spark.createDataFrame([(" a ", 1), ("  ", 2)], "c string, n int").write.parquet(str(tmp_path / "p"))
    back = tables.read_table(spark, str(tmp_path / "p"), "c string, n int").orderBy("n").collect()
    assert [r["c"] for r in back] == ["a", None]


def penalised_gradient(x, y, a, b, c):
    p = 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700)))
    return (y - p).sum(), ((y - p) * x).sum() - b / c


@pytest.mark.parametrize("gap", [0.0, 0.05])
def test_calibrator_reaches_the_optimum_on_separable_scores(spark, gap):
    scores = np.concatenate([np.linspace(0.05, 0.5 - gap, 100), np.linspace(0.5 + gap, 0.95, 100)])
    labels = (np.arange(200) >= 100).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"pd_12m": scores, "default_12m": labels}))
    fit = calibration.fit_calibrator(df)
    x = np.log(scores / (1 - scores))
    g0, g1 = penalised_gradient(x, labels, fit.alpha, fit.beta, 1e6)
    assert fit.beta > 30 and abs(g0) < 1e-6 and abs(g1) < 1e-6
    with pytest.raises(RuntimeError, match="converge"):
        calibration.fit_calibrator(df, max_steps=2)


def test_calibrator_needs_both_classes(spark):
    df = spark.createDataFrame([(0.3, None), (None, 1)], "pd_12m double, default_12m int")
    with pytest.raises(ValueError):
        calibration.fit_calibrator(df)


def t_tail(r, n):
    """Two-sided tail of Student's t by numeric integration."""
    nu = n - 2
    t = abs(r) * math.sqrt(nu / (1 - r * r))
    u = np.linspace(0, t, 400_001)
    density = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    values = density * (1 + u * u / nu) ** (-(nu + 1) / 2)
    return 1 - 2 * np.trapezoid(values, u)


@pytest.mark.parametrize("r,n", [(0.5, 20), (-0.1, 50), (0.02, 5000), (0.9, 5)])
def test_p_values(r, n):
    assert metrics.two_sided_p_value(r, n) == pytest.approx(t_tail(r, n), abs=1e-7)


def test_p_values_at_the_ends():
    assert metrics.two_sided_p_value(1.0, 10) == 0.0 and metrics.two_sided_p_value(0.0, 10) == 1.0
    assert metrics.two_sided_p_value(None, 10) is None and metrics.two_sided_p_value(0.3, 2) is None


@pytest.mark.parametrize("size", [10**6, 40])
def test_rank_correlations_with_gaps(spark, size):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame(rng.integers(0, 30, (400, 4)).astype(float), columns=list("abcd"))
    frame["d"] += frame["a"]
    frame.loc[rng.random(400) < 0.2, "b"] = np.nan
    frame.loc[rng.random(400) < 0.1, "c"] = np.nan
    want = frame.corr(method="spearman")
    rows = metrics.spearman_matrix(spark.createDataFrame(frame), list("abcd"), rows_per_bucket=size).collect()
    assert len(rows) == 6
    for r in rows:
        both = frame[[r["column_a"], r["column_b"]]].dropna()
        assert r["observations"] == len(both)
        assert r["spearman"] == pytest.approx(want.loc[r["column_a"], r["column_b"]])
    one = metrics.spearman(spark.createDataFrame(frame), "a", "d").first()
    assert one["p_value"] == pytest.approx(metrics.two_sided_p_value(one["correlation"], 400))


def test_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(p), int(y), int(n)) for p, y, n in zip(rng.random(300).round(1), rng.integers(0, 2, 300), rng.integers(1, 5, 300))]
    df = spark.createDataFrame(rows, "p double, y int, n int")
    repeated = df.select("p", "y", F.explode(F.sequence(F.lit(1), "n")))
    a = metrics.classification_metrics(df, "p", "y", weight="n").first().asDict()
    b = metrics.classification_metrics(repeated, "p", "y").first().asDict()
    assert a == pytest.approx(b)


def test_copies_weigh_training_rows(spark):
    df = spark.createDataFrame([(1, 3), (0, 1), (0, 2)], "default_12m int, copies long")
    plain = {(r["default_12m"], r["copies"]): r[models.WEIGHT] for r in models.with_weight(df, False).collect()}
    assert plain == {(1, 3): 3.0, (0, 1): 1.0, (0, 2): 2.0}
    even = models.with_weight(df, True).groupBy("default_12m").agg(F.sum(models.WEIGHT).alias("w")).collect()
    assert {r["w"] for r in even} == {3.0}


@pytest.mark.parametrize("size", [10**6, 7])
def test_samples_of_deep_prefixes_and_equal_keys(spark, size):
    df = spark.range(3000).selectExpr("id", "id % 2 AS y", "id % 10 AS k")
    quotas = {0: 700, 1: 2000}
    for key in (["id"], ["k"]):
        order = binning.sample_order(key)
        picks = [
            binning.take_first(d, "y", quotas, order, digits=1, rows_per_bucket=size).collect()
            for d in (df, df.repartition(5))
        ]
        assert sorted(picks[0]) == sorted(picks[1])
        assert [sum(r["y"] == y for r in picks[0]) for y in (0, 1)] == [700, 1500]
    assert sampling.stratified_sample(df, "y", 100, ["k"]).count() == 100


def test_files_of_a_month_follow_its_rows(spark, tmp_path):
    perf = proxy.performance(spark, SF)
    tables.write_performance(perf, str(tmp_path / "p"), rows_per_file=5)
    back = tables.read_parquet(spark, str(tmp_path / "p"))
    assert back.count() == perf.count()
    per_file = back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file <= 5


def test_a_stage_can_be_rebuilt_from_itself(spark, tmp_path):
    stages = StageCatalog(spark, str(tmp_path))
    first = stages.materialize(spark.range(10), "raw.numbers")
    again = stages.materialize(first.where("id < 4"), "raw.numbers")
    assert again.count() == 4


def test_a_failed_rebuild_leaves_the_stage_as_it_was(spark, tmp_path, monkeypatch):
    stages = StageCatalog(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        stages.read("pd.dataset")
    first = stages.materialize(spark.range(10), "pd.dataset")
    # some tasks write their rows before another one fails
    broken = spark.range(0, 100, 1, 8).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        stages.materialize(broken, "pd.dataset")
    assert stages.read("pd.dataset").count() == 10

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("lossgrid.sources.stages.create_empty", killed)
        with pytest.raises(KeyboardInterrupt):
            stages.materialize(spark.range(20), "pd.dataset")
    assert stages.read("pd.dataset").count() == 10 and len(stages.versions("pd.dataset")) == 1
    second = stages.materialize(spark.range(30), "pd.dataset")
    assert second.count() == 30 and first.count() == 10  # a reader of the version before is not disturbed
    stages.materialize(spark.range(40), "pd.dataset")
    assert stages.read("pd.dataset").count() == 40 and len(stages.versions("pd.dataset")) == 2


def test_hot_keys_need_no_more_than_the_bound(spark, monkeypatch):
    """One key with a third of the rows, some above the bound, many below it, and sketches that are far too small."""
    counts = {0: 4000, **{i: 300 for i in range(1, 9)}, **{i: 20 for i in range(100, 400)}}
    rows = spark.createDataFrame([(k, n) for k, n in counts.items()], "loan long, n int")
    rows = rows.select("loan", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at")).unionByName(
        spark.createDataFrame([(None, 1)] * 5, "loan long, at int")
    )
    for limit in (1 << 20, 64):
        monkeypatch.setattr(skew, "SKETCH_LIMIT", limit)
        found = {r["loan"]: r[skew.SALTS] for r in skew.hot_keys(rows, "loan", 200).collect()}
        assert set(range(9)) <= set(found) <= {k for k, n in counts.items() if n > 100}
        assert found[0] >= 40 and found[1] >= 3
    assert skew.hot_keys(rows, "loan", 10_000) is None


def test_of_several_last_balances_one_rule_decides(spark):
    rows = [(1, 202001, 5, 10.0), (1, 202001, 7, 4.0), (1, 202001, 7, 6.0), (2, 202001, 1, None)]
    table = spark.createDataFrame(rows, "loan_identifier long, observation_month int, record_id long, last_upb double")
    by_record = {r["loan_identifier"]: r["last_upb"] for r in ecl.last_balance_map(table, ["record_id"]).collect()}
    assert by_record == {1: 6.0, 2: None}
    assert {r["last_upb"] for r in ecl.last_balance_map(table).collect()} == {10.0, None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_bounds_reach_the_partitions(spark, tmp_path):
    tables.write_performance(proxy.performance(spark, SF), str(tmp_path / "p"))
    perf = tables.read_parquet(spark, str(tmp_path / "p"))
    for df in (panel.snapshot(perf, 199803), panel.between_months(perf, 199802, 199803), panel.observable(perf, 199803)):
        line = next(x for x in plan_of(df).split("PartitionFilters: ")[1:])
        assert line.startswith("[isnotnull(monthly_reporting_period") and "1998" in line.split("]")[0]


def test_no_task_sees_all_rows(spark):
    """Single partitions only appear above partial aggregates and bucket totals."""
    df = proxy.scored(spark, SF)
    table = metrics.classification_metrics(df, "pd_12m", "default_12m", rows_per_bucket=300)
    table.collect()
    lines = [x.strip(" :+-") for x in plan_of(table).split("== Initial Plan ==")[-1].splitlines()]
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert any(word in lines[i + 1] for word in ("HashAggregate", "partial_"))


def test_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "c string, d string")
    assert fit_modes(df, ["c", "d"]) == {"c": "a", "d": None}
