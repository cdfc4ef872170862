"""Order-based measures against pandas and brute force, with one bucket and with many small ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgrid.operators import binning, calibration, drift, features, metrics, order, reports
from lossgrid.operators.order import exact_quantiles, fit_cuts, running_totals

BUCKETS = [10**6, 40]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 1500
    p = np.round(rng.random(n), 3)
    p[: n // 3] = 0.25  # one score holds a third of the rows
    y = (rng.random(n) < 0.2 + 0.4 * p).astype(int)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"id": range(n), "m": rng.integers(1, 4, n), "p": p, "y": y, "x": x, "z": np.round(x * 2) + p, "c": 7.0})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).persist()


def auc_ap(p, y):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    ap, before = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        top = p >= s
        recall = y[top].sum() / y.sum()
        ap += (recall - before) * y[top].mean()
        before = recall
    return wins / (len(pos) * len(neg)), ap


@pytest.mark.parametrize("size", BUCKETS)
def test_classification_metrics(df, frame, size):
    got = metrics.classification_metrics(df, "p", "y", rows_per_bucket=size).first()
    p, y = frame.p.to_numpy(), frame.y.to_numpy()
    auc, ap = auc_ap(p, y)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12) and got["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert got["brier"] == pytest.approx(((p - y) ** 2).mean())
    q = p.clip(1e-15, 1 - 1e-15)
    assert got["log_loss"] == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    for row in metrics.monthly_performance(df, "m", "p", "y", size).collect():
        part = frame[frame.m == row["m"]]
        auc, ap = auc_ap(part.p.to_numpy(), part.y.to_numpy())
        assert (row["roc_auc"], row["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap))


def test_one_class_has_no_area(df):
    row = metrics.classification_metrics(df.where("y = 0"), "p", "y").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["brier"] is not None


@pytest.mark.parametrize("size", BUCKETS)
def test_roc_curve_keeps_its_area(df, frame, size):
    auc, _ = auc_ap(frame.p.to_numpy(), frame.y.to_numpy())
    counts = []
    for drop in (True, False):
        rows = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df, "p", "y", drop, size).collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:]))
        assert area == pytest.approx(auc) and rows[0] == (0, 0) and rows[-1] == (1, 1)
        counts.append(len(rows))
    assert counts[0] < counts[1] == frame.p.nunique() + 1
    assert metrics.pr_points(df, "p", "y", size).count() == frame.p.nunique() + 1


@pytest.mark.parametrize("size", BUCKETS)
def test_running_totals(df, frame, size):
    rows = running_totals(df, "x", {"n": F.lit(1)}, by=["m"], rows_per_bucket=size).collect()
    for r in rows[::50]:
        assert r["n_before"] == ((frame.m == r["m"]) & (frame.x < r["x"])).sum()


def test_heavy_value_gets_its_own_bucket(df):
    cuts = fit_cuts(df, ["p"], 40)["p"]
    assert 0.25 in cuts.heavy and cuts.salts > 2 and cuts.splits == sorted(set(cuts.splits))


@pytest.mark.parametrize("size", BUCKETS)
def test_quantiles(df, frame, size):
    probs = [0, 0.1, 0.25, 0.5, 0.777, 1]
    got = exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), {"x": probs, "p": probs, "none": [0.5]}, size)
    assert got["none"] is None
    for c in ("x", "p"):
        assert got[c] == pytest.approx(list(frame[c].quantile(probs)), abs=1e-14)


@pytest.mark.parametrize("size", BUCKETS)
def test_qcut(df, frame, size):
    for c, q in (("p", 10), ("x", 7), ("z", 4)):
        rows = binning.qcut(df, c, q, "b", size).select("id", "b").toPandas().sort_values("id").b
        expected = pd.qcut(frame[c], q, labels=False, duplicates="drop")
        assert np.array_equal(rows.to_numpy(float), expected.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("size", BUCKETS)
def test_spearman_matrix(df, frame, size):
    columns = ["p", "x", "z", "c"]
    expected = frame[columns].corr(method="spearman")
    for r in metrics.spearman_matrix(df, columns, size).collect():
        value = expected.loc[r["column_a"], r["column_b"]]
        if math.isnan(value):
            assert r["spearman"] is None
        else:
            assert r["spearman"] == pytest.approx(value, abs=1e-12)


def test_pearson(df, frame):
    assert metrics.pearson(df, "x", "z").first()["correlation"] == pytest.approx(frame.x.corr(frame.z))
    assert metrics.pearson(df, "x", "c").first()["correlation"] is None


@pytest.mark.parametrize("size", BUCKETS)
def test_capture_counts_the_tied_group_in_part(df, frame, size):
    order = frame.assign(h=[__import__("hashlib").md5(f"42:{i}".encode()).hexdigest() for i in frame.id])
    order = order.sort_values(["p", "h"], ascending=[False, True])
    for r in binning.capture_lift(df, "p", "y", ["id"], rows_per_bucket=size).collect():
        top = order.head(len(frame) * r["top_percent"] // 100)
        assert (r["observations"], r["defaults_captured"]) == (len(top), top.y.sum())
        assert r["lift"] == pytest.approx(top.y.mean() / frame.y.mean())


@pytest.mark.parametrize("size", BUCKETS)
def test_psi(df, frame, size):
    same = {r["feature"]: r["psi"] for r in drift.psi(df, df, ["x", "p", "c"], rows_per_bucket=size).collect()}
    assert all(v == pytest.approx(0, abs=1e-15) for v in same.values()) and len(same) == 3
    moved = drift.psi(df, df.withColumn("x", F.col("x") + 1), ["x", "p"], rows_per_bucket=size).collect()
    edges = np.unique(frame.x.quantile(np.arange(11) / 10))
    share = lambda v: np.maximum(np.append(np.bincount(np.searchsorted(edges[1:-1], v.dropna(), side="left"), minlength=10), v.isna().sum()) / len(v), 1e-6)
    e, a = share(frame.x), share(frame.x + 1)
    assert moved[0]["feature"] == "x" and moved[0]["psi"] == pytest.approx(((a - e) * np.log(a / e)).sum())


def test_calibration_restores_the_level(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(-2, 1.5, 20000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(0.7 + 0.6 * z)))).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"pd_12m": 1 / (1 + np.exp(-z)), "default_12m": y})).persist()
    fit = calibration.fit_calibrator(rows)
    assert (fit.alpha, fit.beta) == (pytest.approx(0.7, abs=0.1), pytest.approx(0.6, abs=0.05))
    after = fit.transform(rows)
    assert after.agg(F.avg("pd_12m_cal")).first()[0] == pytest.approx(y.mean(), abs=1e-9)
    a = metrics.classification_metrics(rows, "pd_12m", "default_12m").first()
    b = metrics.classification_metrics(after, "pd_12m_cal", "default_12m").first()
    assert (a["roc_auc"], a["pr_auc"]) == (pytest.approx(b["roc_auc"]), pytest.approx(b["pr_auc"]))
    assert b["log_loss"] < a["log_loss"]


@pytest.mark.parametrize("size", BUCKETS)
def test_imputer_and_buckets(spark, df, frame, size):
    words = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "v double, s string")
    fit = features.fit_imputer(words, ["v"], ["s"], size)
    assert fit.medians == {"v": 2.5} and fit.modes == {"s": "a"}
    table = reports.severity_buckets(df, "p", "x", 5, size).toPandas().sort_values("risk_group")
    groups = frame.groupby(pd.qcut(frame.p, 5, labels=False, duplicates="drop"))
    assert table.observations.tolist() == groups.size().tolist()
    assert table.median_actual_lgd.tolist() == pytest.approx(groups.x.median().tolist())


def exchanges(frame):
    """What the rows were shuffled by, each exchange that ran once, as the query was finally executed."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if " Exchange hashpartitioning" in line and "ReusedExchange" not in line]


@pytest.mark.parametrize("by", [[], ["m"]])
def test_ordered_metrics_shuffle_their_rows_once(spark, by):
    """Near-distinct scores in many buckets: one exchange by bucket serves the ties, the order and the totals."""
    rows = spark.range(20_000).select(
        (F.xxhash64("id") % 1_000_003 / 2_000_006 + 0.5).alias("p"), (F.col("id") % 7 == 0).cast("int").alias("y"),
        (F.col("id") % 3).alias("m"),
    )
    groups = metrics.score_groups(rows, "p", "y", by, rows_per_bucket=1000)
    found = exchanges(groups)
    assert sum("REPARTITION_BY_COL" in line for line in found) == 1
    assert not [line for line in found if "p#" in line.split("hashpartitioning")[1].split(")")[0]]


def test_frequent_scores_are_combined_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(1)).alias("p"), (F.col("id") % 7 == 0).cast("int").alias("y")
    ).persist()
    cuts = fit_cuts(rows, ["p"], 1000, frequent=True)["p"]
    assert cuts.frequent == (0.25,)
    groups = metrics.score_groups(rows, "p", "y", rows_per_bucket=1000)
    assert groups.where("p = 0.25").agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 10_000
    metrics_of = metrics.classification_metrics(rows, "p", "y", rows_per_bucket=1000).first()
    frame = rows.toPandas()
    auc, ap = auc_ap(frame.p.to_numpy()[:3000], frame.y.to_numpy()[:3000])
    some = metrics.classification_metrics(spark.createDataFrame(frame[:3000]), "p", "y", rows_per_bucket=100).first()
    assert (some["roc_auc"], some["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap)) and metrics_of["observations"] == 30_000


@pytest.mark.parametrize("size", BUCKETS)
def test_weights_equal_repeated_rows(spark, df, size):
    weighted = df.withColumn("w", F.when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 4))
    repeated = df.withColumn("w", F.explode(F.expr("sequence(1, int(id % 4))"))).where("id % 4 > 0 and id % 50 <> 1")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    a, b = exact_quantiles(weighted, {"x": probs, "p": probs}, size, "w"), exact_quantiles(repeated, {"x": probs, "p": probs}, size)
    assert a == b
    for f in (
        lambda d, **k: calibration.calibration_table(d, "p", "y", 7, size, **k),
        lambda d, **k: binning.capture_lift(d, "p", "y", ["id"], rows_per_bucket=size, **k),
        lambda d, **k: drift.psi_bins(d.where("m = 1"), d.where("m > 1"), ["x", "p"], 5, size, **k),
        lambda d, **k: metrics.roc_points(d, "p", "y", rows_per_bucket=size, **k),
        lambda d, **k: metrics.pr_points(d, "p", "y", size, **k),
        lambda d, **k: metrics.classification_metrics(d, "p", "y", ["m"], size, **k),
    ):
        one, two = (sorted(map(tuple, f(d, **k).collect()), key=str) for d, k in ((weighted, {"weight": "w"}), (repeated, {})))
        assert len(one) == len(two)
        for r, q in zip(one, two, strict=True):
            assert r == pytest.approx(q, nan_ok=True)
    fits = [calibration.fit_calibrator(d, "p", "y", weight=k) for d, k in ((weighted, "w"), (repeated, None))]
    assert fits[0] == pytest.approx(fits[1])
    sample = [binning.take_first(d, "y", {0: 200, 1: 55}, binning.sample_order(["id"]), 1, size, k) for d, k in ((weighted, "w"), (repeated, None))]
    counts = [{r["id"]: r[1] for r in s.groupBy("id").agg(n).collect()} for s, n in zip(sample, (F.sum("w"), F.count("w")))]
    assert counts[0] == counts[1]
    stages = [features.fit_imputer(d, ["x"], ["m"], size, k) for d, k in ((weighted, "w"), (repeated, None))]
    scales = [features.fit_scaler(d, ["p", "z"], k) for d, k in ((weighted.where("not isnan(x)"), "w"), (repeated.where("not isnan(x)"), None))]
    assert stages[0] == stages[1] and scales[0].means == pytest.approx(scales[1].means)
    assert scales[0].deviations == pytest.approx(scales[1].deviations)


def test_maps_of_a_score_share_one_table(spark, df):
    fit = calibration.Calibrator(-0.3, 0.8)
    tables = metrics.mapped_metrics(df, "p", "y", {"raw": "p", "cal": fit.apply("p"), "down": 1 - F.col("p"), "one": F.lit(0.5)})
    for name, column in (("raw", F.col("p")), ("cal", fit.apply("p")), ("down", 1 - F.col("p")), ("one", F.lit(0.5))):
        want = metrics.classification_metrics(df.withColumn("q", column), "q", "y").first()
        assert tuple(tables[name].first()) == pytest.approx(tuple(want))


@pytest.mark.parametrize("size", BUCKETS)
def test_grouped_quantiles_and_correlations(spark, df, frame, size):
    frame = frame.assign(g=frame.id % 37, v=np.round(frame.x, 1), u=frame.z + frame.p)
    frame.loc[frame.g == 5, "v"] = 3.0  # a constant group
    frame.loc[frame.g == 6, "v"] = np.nan  # and one without values
    rows = spark.createDataFrame(frame)
    got = {(r["g"], r["prob"]): r["quantile"] for r in order.grouped_quantiles(rows, ["g"], "v", [0, 0.3, 0.5, 1], size).collect()}
    for g, part in frame.groupby("g"):
        values = part.v.dropna()
        for p in (0, 0.3, 0.5, 1):
            assert got.get((g, p)) == (pytest.approx(values.quantile(p)) if len(values) else None)
    found = {r["g"]: r for r in metrics.grouped_correlations(rows, ["g"], "v", "u", size).collect()}
    for g, part in frame.groupby("g"):
        both = part[["v", "u"]].dropna()
        if both.empty:
            assert g not in found
            continue
        r = found[g]
        assert r["observations"] == len(both)
        for name, x, y in (("pearson", both.v, both.u), ("spearman", both.v.rank(), both.u.rank())):
            if both.v.nunique() == 1:
                assert r[name] is None and r[f"{name}_p"] is None
            else:
                want = np.corrcoef(x, y)[0, 1]
                assert r[name] == pytest.approx(want, abs=1e-9)
                assert r[f"{name}_p"] == pytest.approx(metrics.two_sided_p_value(want, len(both)), abs=1e-9)


def test_ordering_tasks_follow_the_rows(spark):
    """More rows give more tasks, not larger ones, in both ordered shuffles; without them the session's number stays."""
    rows = spark.range(2000).select(
        (F.col("id") % 7).alias("g"), (F.col("id") % 991).cast("double").alias("v"), (F.col("id") % 13).cast("double").alias("w")
    )
    total = lambda: sorted(order.running_totals(rows, "v", {"n": F.lit(1)}, ["g"], rows_per_bucket=100).collect())
    ranks = lambda: metrics.spearman_matrix(rows, ["g", "v", "w"], 100).collect()
    before = total(), ranks()
    spark.conf.set("lossgrid.rowsPerTask", "50")
    try:
        assert order.spread(rows, 2000, "g").rdd.getNumPartitions() == 40
        assert order.spread(rows, 100, "g").rdd.getNumPartitions() <= 4
        table = metrics.spearman_matrix(rows, ["g", "v", "w"], 100)
        plan = table._jdf.queryExecution().executedPlan().toString()
        # 3 columns of 2000 rows: ranked in 120 tasks, put together in 120, and the offsets join without a shuffle
        assert plan.count(", 120), REPARTITION_BY_NUM") >= 2 and "SortMergeJoin" not in plan
        after = total(), ranks()
    finally:
        spark.conf.unset("lossgrid.rowsPerTask")
    assert after[0] == before[0]
    for a, b in zip(after[1], before[1], strict=True):
        assert a[:3] == b[:3] and a.spearman == pytest.approx(b.spearman, abs=1e-12)
