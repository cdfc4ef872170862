import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgrid.fixed import PD_CATEGORICAL, PD_NUMERIC
from lossgrid.operators import ecl, metrics, models, reports
from lossgrid.plans import proxy, queries
from lossgrid.session import use_checkpoint_dir
from lossgrid.sources import schemas, tables
from lossgrid.sources.stages import StageCatalog

FOLDER = "/root/testdata/sf0.001"
SCORED = (
    "loan_identifier string, observation_month int, months_to_legal_maturity int, zero_balance_code int, "
    "current_loan_delinquency_status string, interest_rate double, pd_12m_cal double, lgd double, "
    "current_actual_upb double, last_upb double"
)


def test_loss_precedence(spark):
    rows = [
        ("one", 1, 60, None, "0", 4.0, 0.1, 0.5, 100.0, None),
        ("two", 1, 60, None, "2", 4.0, 0.1, 0.5, 100.0, None),
        ("due", 1, -11, None, "3", 4.0, 0.1, 0.5, 100.0, None),
        ("lost", 1, 0, 3, "4", 4.0, 0.1, 0.5, 0.0, 80.0),
        ("gone", 1, 60, 3, "4", 4.0, 0.1, 0.5, 0.0, None),
        ("paid", 1, 60, 1, "0", 4.0, 0.1, 0.5, 0.0, None),
    ]
    out = {r["loan_identifier"]: r for r in ecl.compute_ecl(spark.createDataFrame(rows, SCORED)).collect()}
    assert "paid" not in out
    assert out["one"]["ecl"] == pytest.approx(5.0) and out["due"]["ecl"] == pytest.approx(5.0)
    assert out["two"]["ecl"] > 3 * out["one"]["ecl"] and out["due"]["months_to_legal_maturity"] == 0
    assert out["lost"]["ecl"] == pytest.approx(40.0) and out["lost"]["ead"] == 80.0
    assert out["gone"]["ecl"] is None and out["gone"]["stage"] == 3


def test_shares_and_deciles(spark):
    frame = queries.decile_frame(spark, FOLDER)
    table = reports.decile_ecl(frame).toPandas()
    assert len(table) <= 10 and table.loans.sum() == frame.where("pd_decile is not null").count()
    assert table.ecl_share.sum() == pytest.approx(1.0)


def test_no_term_structure_without_months(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1, 3), (0.1, -2)], "p double, m int")
    out = ecl.pd_term_structure(df, "p", "m").orderBy("t").collect()
    assert [r["t"] for r in out] == [1, 2, 3]
    assert out[-1]["cumulative_pd"] == pytest.approx(sum(r["marginal_pd"] for r in out))


def test_csv_source_is_trimmed(spark, tmp_path):
    names = schemas.column_names(schemas.ORIGINATION)
    line = {n: "" for n in names} | {"loan_identifier": "F1", "credit_score": "700", "harp_indicator": " ", "channel": "R "}
    (tmp_path / "o.txt").write_text("|".join(line[n] for n in names) + "\n")
    row = tables.read_origination(spark, str(tmp_path / "o.txt"), "csv").first()
    assert (row["loan_identifier"], row["credit_score"], row["harp_indicator"], row["channel"]) == ("F1", 700, None, "R")
    assert len(names) == 31 and len(schemas.column_names(schemas.PERFORMANCE)) == 35


def test_stage_catalog_and_month_pruning(spark, tmp_path):
    perf = proxy.performance(spark, FOLDER)
    path = str(tmp_path / "perf")
    tables.write_performance(perf, path)
    back = tables.read_parquet(spark, path)
    one = back.where(F.col("monthly_reporting_period") == 199803)
    assert "PartitionFilters: [isnotnull(monthly_reporting_period" in one._jdf.queryExecution().executedPlan().toString()
    assert back.count() == perf.count()
    stages = StageCatalog(spark, str(tmp_path))
    for _ in (1, 2):
        kept = stages.materialize(perf.select("loan_identifier", "record_id"), "raw.performance")
    assert kept.count() == perf.count() == stages.read("raw.performance").count()
    with pytest.raises(ValueError):
        stages.path("performance")
    tables.write_csv(perf.select("record_id").limit(5), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "record_id long").count() == 5


@pytest.mark.parametrize("name", ["pd_panel_bucketed", "last_balance_bucketed"])
def test_bucketed_stages_are_not_shuffled_on_the_loan(spark, monkeypatch, name):
    before = {t.name for t in spark.catalog.listTables()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = queries.REGISTRY[name](spark, FOLDER)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange" not in plan and ("SortMergeJoin" in plan or "Window" in plan)
    assert {t.name for t in spark.catalog.listTables()} == before and frame.count() > 0


def test_a_bucketed_stage_is_read_back_bucketed(spark, tmp_path):
    stages = StageCatalog(spark, str(tmp_path))
    rows = spark.range(100).select((F.col("id") % 7).alias("loan"), F.lit("x").alias("a b"), "id")
    stages.materialize(rows, "raw.t", bucket_by="loan", buckets=4)
    back = StageCatalog(spark, str(tmp_path)).read("raw.t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert "Exchange" not in back.groupBy("loan").count()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        stages.materialize(rows, "raw.t", ["loan"], "loan")


def test_bucketed_tables_join_without_shuffle(spark):
    tables.write_bucketed(proxy.performance(spark, FOLDER), "b_perf", 4)
    tables.write_bucketed(proxy.origination(spark, FOLDER), "b_orig", 4)
    joined = spark.table("b_perf").hint("merge").join(spark.table("b_orig"), "loan_identifier")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def planted(spark, n=1200):
    """A panel whose default rate follows the delinquency and the credit score."""
    rng = np.random.default_rng(11)
    data = {c: rng.normal(100, 20, n) for c in PD_NUMERIC} | {c: rng.choice(["A", "B", None], n) for c in PD_CATEGORICAL}
    data["delinquency_status_numeric"] = rng.integers(0, 4, n).astype(float)
    data["dti"] = np.where(rng.random(n) < 0.2, np.nan, data["dti"])
    z = -2 + 1.2 * data["delinquency_status_numeric"] - 0.05 * (data["credit_score"] - 100)
    data["default_12m"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return spark.createDataFrame(pd.DataFrame(data)).persist()


@pytest.mark.parametrize("kind", ["lr", "gbt", "rf", "gbt_wide"])
def test_models_find_a_planted_signal(spark, tmp_path, kind):
    rows = planted(spark)
    small = {"lr": {"maxIter": 50}, "rf": {"trees": 10, "most_depth": 5}}.get(kind, {"rounds": 5})
    model = models.fit_pd(rows, kind, **small)
    scored = models.score_pd(model, rows)
    assert metrics.classification_metrics(scored, "pd_12m", "default_12m").first()["roc_auc"] > 0.75
    if kind == "lr":
        models.save_model(model, str(tmp_path / "m"))
        again = models.score_pd(models.load_model(str(tmp_path / "m")), rows)
        assert again.agg(F.sum("pd_12m")).first()[0] == pytest.approx(scored.agg(F.sum("pd_12m")).first()[0])
        unseen = models.score_pd(model, rows.withColumn("channel", F.lit("never seen")))
        assert unseen.where("pd_12m is null").count() == 0


PLANS = [
    "default_events", "pd_panel_first", "pd_panel_all", "severity_dataset", "last_balance", "ecl_portfolio",
    "monthly_performance", "capture_lift", "spearman_matrix", "psi_table",
]


@pytest.mark.parametrize("name", PLANS)
def test_plans_stay_in_the_jvm_and_off_cross_joins(spark, name):
    plan = queries.REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert bad not in plan


def test_lag_reaches_only_loans_with_a_default(spark):
    plan = queries.REGISTRY["last_balance"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_checkpoint_dir_follows_the_session(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    if before is None:
        folder = use_checkpoint_dir(spark, str(tmp_path))
        assert folder == str(tmp_path) and spark.sparkContext.getCheckpointDir() is not None
