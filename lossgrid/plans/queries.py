"""Registered queries: each operator over the whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossgrid.fixed import (
    CORRELATION_COLUMNS,
    CORRELATION_LAST_MONTH,
    DRIFT_FEATURES,
    PD_CATEGORICAL,
    PD_NUMERIC,
    SENTINELS,
    TRAIN_ROWS,
    VALIDATION_ROWS,
)
from lossgrid.functions.months import date_to_ym, ym_add, ym_to_date, ym_year
from lossgrid.functions.scalars import (
    clip,
    delinquency_bucket,
    from_log_odds,
    is_not,
    log_odds,
    parse_numeric_status,
    realised_ratio,
)
from lossgrid.operators import (
    binning,
    calibration,
    clean,
    drift,
    ecl,
    features,
    metrics,
    models,
    order,
    panel,
    reports,
    sampling,
)
from lossgrid.operators import severity as sev
from lossgrid.operators.skew import hot_keys
from lossgrid.plans import proxy
from lossgrid.session import materialise, shared_folder
from lossgrid.sources import tables
from lossgrid.sources.schemas import ORIGINATION, PERFORMANCE, column_names
from lossgrid.sources.stages import StageCatalog
from lossgrid.sources.tables import load_features, read_origination, read_performance

LOAN, MONTH = panel.LOAN, panel.MONTH
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ORDER = [MONTH, "record_id"]
ROW = [LOAN, "observation_month", "record_id"]
# years of the data at hand for training, validation and test
SPLIT = {"train": (None, 1998), "validation": (1999, 1999), "test": (2000, 2001)}
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Fractions to a fixed number of places, since sums of doubles depend on their order."""
    return df.select(
        *[
            F.round(f.name, other.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def loans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    """Performance, origination and the loans too heavy for one task."""
    perf = proxy.performance(spark, d)
    return perf, proxy.origination(spark, d), hot_keys(perf, LOAN)


def labelled(spark: SparkSession, d: str, policy: str = "first") -> DataFrame:
    perf, orig, hot = loans(spark, d)
    return panel.pd_panel(perf, orig, cutoff=proxy.CUTOFF_MONTH, policy=policy, hot=hot)


# ---- panel ----


@query
def default_events(spark, d):
    return panel.default_events(proxy.performance(spark, d))


@query
def origination_attach(spark, d):
    perf, orig, hot = loans(spark, d)
    renamed = clean.select_as(
        clean.clean_sentinels(orig, "train"),
        {LOAN: LOAN, "credit_score": "credit_score", "dti": "dti", "upb": "original_upb", "property_state": "state"},
    )
    return panel.attach_origination(perf.select(LOAN, MONTH, "record_id", "current_actual_upb"), renamed, hot)


@query
def pd_panel_first(spark, d):
    return labelled(spark, d).select(
        LOAN, "observation_month", "record_id", "credit_score", "original_upb", "current_actual_upb", "default_12m"
    )


def bucketed_loans(spark, d) -> tuple[DataFrame, DataFrame]:
    """Performance and origination as stages bucketed by loan, under a folder of their own."""
    stages = StageCatalog(spark, f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}")
    sides = {"raw.performance": proxy.performance(spark, d), "raw.origination": proxy.origination(spark, d)}
    perf, orig = (stages.materialize(df, name, bucket_by=LOAN, buckets=8) for name, df in sides.items())
    return perf, orig


@query
def pd_panel_bucketed(spark, d):
    """The panel from bucketed stages: joined and grouped on the loan without a shuffle."""
    perf, orig = bucketed_loans(spark, d)
    return panel.pd_panel(perf, orig, cutoff=proxy.CUTOFF_MONTH).select(
        LOAN, "observation_month", "record_id", "credit_score", "original_upb", "current_actual_upb", "default_12m"
    )


@query
def last_balance_bucketed(spark, d):
    """The lag from a bucketed stage, without a shuffle on the loan."""
    return ecl.last_balance(bucketed_loans(spark, d)[0], order=ORDER)


@query
def pd_panel_all(spark, d):
    return labelled(spark, d, "all").select(
        LOAN, "observation_month", "record_id", "original_upb", "default_12m", "copies"
    )


@query
def feature_typing(spark, d):
    return clean.model_data(labelled(spark, d), "train")


@query
def feature_load(spark, d):
    source = clean.model_data(labelled(spark, d), "train")
    return load_features(source, [*PD_NUMERIC, "loan_age", "months_to_legal_maturity", "default_12m"])


@query
def sentinel_profiles(spark, d):
    orig = proxy.origination(spark, d)
    columns = [c for c in orig.columns if any(c in rules for rules in SENTINELS.values())]
    # one pass: a row carries its form under every profile
    forms = [
        F.struct(*[clean.without_markers(c, p) for c in columns], F.lit(p).alias("profile")) for p in SENTINELS
    ]
    return orig.select(LOAN, F.inline(F.array(*forms)))


@query
def snapshot_month(spark, d):
    month = proxy.SNAPSHOT_MONTH
    rows = panel.snapshot(proxy.performance(spark, d, month, month), month)
    return rows.select(LOAN, MONTH, "record_id", "current_actual_upb", "zero_balance_code")


@query
def month_range(spark, d):
    rows = panel.between_months(proxy.performance(spark, d, 199802, 199803), 199802, 199803)
    return rows.select(LOAN, MONTH, "record_id", "current_actual_upb")


def own_folder(spark, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query
def stored_performance(spark, d):
    """Performance written by month and read back; the months asked for prune its folders."""
    path = own_folder(spark, "performance")
    tables.write_performance(proxy.performance(spark, d), path)
    rows = panel.between_months(tables.read_parquet(spark, path), 199802, 199803)
    return rows.select(LOAN, MONTH, "record_id", "current_actual_upb")


@query
def stored_stage(spark, d):
    """A stage that is rebuilt from itself and read by its name."""
    stages = StageCatalog(spark, own_folder(spark, "stages"))
    first = stages.materialize(proxy.performance(spark, d), "pd.dataset", [MONTH])
    stages.materialize(first.where(F.col(MONTH) <= 199803).select(LOAN, "record_id", MONTH, "current_actual_upb"), "pd.dataset")
    return panel.between_months(stages.read("pd.dataset"), 199802, 199803).select(LOAN, MONTH, "record_id", "current_actual_upb")


@query
def stored_csv(spark, d):
    """Predictions exported with a header line and read with a declared schema."""
    path = own_folder(spark, "csv")
    rows = proxy.performance(spark, d).select(LOAN, MONTH, "record_id", F.expr(proxy.FORMULA_PD))
    tables.write_csv(rows, path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rounded(tables.read_csv(spark, path, kinds), 9)


@query
def declared_tables(spark, d):
    """Both raw tables as delimited text, read with their declared schemas and joined."""
    texts = {}
    for name, schema, rows in (
        ("origination", ORIGINATION, proxy.origination(spark, d)),
        ("performance", PERFORMANCE, proxy.performance(spark, d)),
    ):
        texts[name] = own_folder(spark, name)
        known = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in column_names(schema)]
        rows.select(*known).write.option("sep", "|").option("header", False).csv(texts[name])
    orig = read_origination(spark, texts["origination"], "csv")
    perf = read_performance(spark, texts["performance"], "csv")
    rows = panel.attach_origination(perf.where(F.col(MONTH) == 199803), orig)
    return rows.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("credit_score").cast("long").alias("credit_score"),
        F.round(F.sum("current_actual_upb"), 2).cast("double").alias("current_actual_upb"),
    )


@query
def observable_rows(spark, d):
    rows = panel.observable(proxy.performance(spark, d, None, proxy.CUTOFF_MONTH), proxy.CUTOFF_MONTH)
    return rows.groupBy(MONTH).agg(F.count(F.lit(1)).alias("n"))


@query
def month_arithmetic(spark, d):
    rows = proxy.performance(spark, d)
    return rows.select(
        "record_id",
        ym_year(MONTH).alias("year"),
        ym_add(MONTH, -1).alias("month_before"),
        ym_add(MONTH, 12).alias("year_later"),
        F.date_format(ym_to_date(MONTH), "yyyy-MM-dd").alias("first_day"),
        date_to_ym(F.last_day(ym_to_date(MONTH))).alias("same_month"),
    )


@query
def status_codes(spark, d):
    rows = proxy.performance(spark, d)
    code = "current_loan_delinquency_status"
    return rows.where(is_not("zero_balance_code", 1)).select(
        "record_id", parse_numeric_status(code).alias("months_behind"), delinquency_bucket(code).alias("bucket")
    )


@query
def monthly_default_rate(spark, d):
    return rounded(panel.target_drift(labelled(spark, d)), 9)


@query
def monthly_default_rate_all_events(spark, d):
    return rounded(panel.target_drift(labelled(spark, d, "all")), 9)


# ---- severity ----


@query
def severity_history(spark, d):
    return sev.severity_history(proxy.performance(spark, d)).select(
        LOAN, "observation_month", "default_month", "event_records", "observation_type", "record_id", "eltv",
        "current_actual_upb", "zero_balance_code", "modification_flag", "borrower_assistance_plan",
    )


@query
def severity_dataset(spark, d):
    perf, orig, hot = loans(spark, d)
    rows = sev.severity_dataset(sev.severity_history(perf), orig, hot)
    return rounded(
        rows.select(
            LOAN, "default_month", "record_id", "observation_month", "eltv", "modification_flag",
            "payment_deferral_flag", "credit_score", "ltv", "ead", "lgd", "lgd_model",
        ),
        ead=2,
    )


@query
def severity_dataset_repeated(spark, d):
    """The source workflow's rule: a feature row once per target of its event."""
    perf, orig, hot = loans(spark, d)
    rows = sev.severity_dataset(sev.severity_history(perf), orig, hot, duplicates="repeat")
    return rounded(rows.select(LOAN, "default_month", "record_id", "ead", "lgd", "lgd_model", "parts"), ead=2)


@query
def severity_keys(spark, d):
    history = sev.severity_history(proxy.performance(spark, d))
    before = history.where(F.col("observation_type") == "1_month_before")
    targets = sev.valid_severity(history.where(F.col("observation_type") == "default_month"))
    return sev.restrict_to(before, targets, sev.EVENT).select(LOAN, "default_month", "record_id")


@query
def realised_severity(spark, d):
    rows = sev.valid_severity(proxy.severity(spark, d))
    ead = F.col("delinquent_accrued_interest") + F.col("zero_balance_removal_upb")
    out = rows.withColumn("ead", ead).withColumn("lgd", realised_ratio("actual_loss", "ead"))
    out = out.withColumn("lgd_model", clip("lgd", 0.0, 1.0))
    return rounded(out.select(*KEY, "ead", "lgd", "lgd_model"), 9, ead=4)


def severity_frame(spark, d) -> DataFrame:
    """Line items as scored severity rows: realised target beside a given prediction."""
    rows = sev.valid_severity(proxy.severity(spark, d))
    ead = F.col("delinquent_accrued_interest") + F.col("zero_balance_removal_upb")
    return rows.withColumn("lgd_model", clip(realised_ratio("actual_loss", ead), 0.0, 1.0))


@query
def regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(severity_frame(spark, d), "lgd_pred", "lgd_model"))


@query
def annual_severity(spark, d):
    return rounded(reports.annual_severity(severity_frame(spark, d), "observation_month"))


@query
def severity_buckets(spark, d):
    return rounded(reports.severity_buckets(severity_frame(spark, d)))


@query
def severity_correlations(spark, d):
    """Correlations of predicted and actual severity by year of the observation, with p-values."""
    rows = severity_frame(spark, d).withColumn("year", ym_year("observation_month"))
    return rounded(reports.severity_correlations(rows, ["year"]), 6)


@query
def severity_quantiles(spark, d):
    """Quartiles of the actual severity by year and predicted quintile."""
    rows = binning.qcut(severity_frame(spark, d), "lgd_pred", 5, "risk_group").withColumn("year", ym_year("observation_month"))
    table = order.grouped_quantiles(rows, ["year", "risk_group"], "lgd_model", [0.25, 0.5, 0.75])
    return rounded(table, 6)


@query
def mean_severity_baseline(spark, d):
    rows = severity_frame(spark, d)
    parts = sampling.temporal_split(rows, "observation_month", SPLIT)
    both = parts["validation"].unionByName(parts["test"])
    scored = models.mean_severity(parts["train"], both.drop("lgd_pred"))
    return rounded(reports.annual_severity(scored, "observation_month"))


@query
def pearson_correlation(spark, d):
    return rounded(metrics.pearson(severity_frame(spark, d), "lgd_pred", "lgd_model"))


@query
def spearman_correlation(spark, d):
    return rounded(metrics.spearman(severity_frame(spark, d), "lgd_pred", "lgd_model"))


@query
def spearman_matrix_performance(spark, d):
    perf, orig, hot = loans(spark, d)
    rows = panel.attach_origination(
        clean.clean_sentinels(perf, "lgd").drop("interest_rate"), clean.clean_sentinels(orig, "lgd"), hot
    )
    columns = ["eltv", "ltv", "current_actual_upb", "loan_age", "credit_score", "current_interest_rate"]
    return rounded(metrics.spearman_matrix(rows, columns))


@query
def spearman_matrix(spark, d):
    rows = severity_rows(spark, d)
    rows = rows.where(F.col("default_month") <= CORRELATION_LAST_MONTH)
    return rounded(metrics.spearman_matrix(rows, CORRELATION_COLUMNS))


# ---- classification ----


@query
def classification_metrics(spark, d):
    return rounded(metrics.classification_metrics(proxy.scored(spark, d), "pd_12m", "default_12m"), 8)


@query
def classification_metrics_tied(spark, d):
    return rounded(metrics.classification_metrics(proxy.scored(spark, d), "p_tie", "default_12m"), 8)


@query
def monthly_performance(spark, d):
    return rounded(metrics.monthly_performance(proxy.scored(spark, d), "observation_month", "pd_12m", "default_12m"), 8)


@query
def monthly_performance_all_events(spark, d):
    """Rows that several events repeat count once per copy."""
    rows = labelled(spark, d, "all").select("observation_month", "default_12m", "copies", F.expr(proxy.FORMULA_PD))
    table = metrics.monthly_performance(rows, "observation_month", "pd_12m_cal", "default_12m", weight="copies")
    return rounded(table, 8)


def repeated(spark, d) -> DataFrame:
    """The scored panel whose rows stand for as many copies as they match events."""
    return labelled(spark, d, "all").select(
        LOAN, "observation_month", "record_id", "default_12m", "copies", F.expr(proxy.FORMULA_PD), "original_upb"
    )


@query
def calibration_table_all_events(spark, d):
    table = calibration.calibration_table(repeated(spark, d), "pd_12m_cal", "default_12m", weight="copies")
    return rounded(table, 8)


@query
def capture_lift_all_events(spark, d):
    return rounded(binning.capture_lift(repeated(spark, d), "pd_12m_cal", "default_12m", ["record_id", "default_12m"], weight="copies"))


@query
def psi_all_events(spark, d):
    rows = materialise(repeated(spark, d), "psi")
    parts = sampling.temporal_split(rows, "observation_month", {"train": (None, 1997), "test": (1998, 2001)})
    return rounded(drift.psi(parts["train"], parts["test"], ["pd_12m_cal", "original_upb"], weight="copies"), 8)


@query
def roc_points_all_events(spark, d):
    return rounded(metrics.roc_points(repeated(spark, d), "pd_12m_cal", "default_12m", weight="copies"), 9)


@query
def calibrator_all_events(spark, d):
    fit = calibration.fit_calibrator(repeated(spark, d), "pd_12m_cal", "default_12m", weight="copies")
    return spark.range(1).select(F.round(F.lit(fit.alpha), 6).alias("alpha"), F.round(F.lit(fit.beta), 6).alias("beta"))


@query
def stratified_sample_all_events(spark, d):
    """Row copies are sampled one by one: `copies` is how many of a row's are in the sample."""
    rows = repeated(spark, d).select("record_id", "default_12m", "copies")
    return sampling.stratified_fraction(rows, "default_12m", 0.3, ["record_id"], weight="copies")


@query
def roc_points(spark, d):
    return rounded(metrics.roc_points(proxy.scored(spark, d), "pd_12m", "default_12m"), 9)


@query
def roc_points_tied(spark, d):
    return rounded(metrics.roc_points(proxy.scored(spark, d), "p_tie", "default_12m", drop_collinear=False), 9)


@query
def pr_points(spark, d):
    return rounded(metrics.pr_points(proxy.scored(spark, d), "pd_12m", "default_12m"), 9)


@query
def capture_lift(spark, d):
    return rounded(binning.capture_lift(proxy.scored(spark, d), "pd_12m", "default_12m", KEY))


@query
def capture_lift_tied(spark, d):
    return rounded(binning.capture_lift(proxy.scored(spark, d), "p_tie", "default_12m", KEY))


@query
def calibration_table(spark, d):
    return rounded(calibration.calibration_table(proxy.scored(spark, d), "pd_12m", "default_12m"), 8)


@query
def calibration_table_tied(spark, d):
    return rounded(calibration.calibration_table(proxy.scored(spark, d), "p_tie", "default_12m"), 8)


def calibrated(spark, d) -> DataFrame:
    """Calibrated on the validation year, applied to the test year."""
    parts = sampling.temporal_split(proxy.scored(spark, d), "observation_month", SPLIT)
    return calibration.fit_calibrator(parts["validation"]).transform(parts["test"])


@query
def calibrated_scores(spark, d):
    return rounded(calibrated(spark, d).select(*KEY, "pd_12m_cal"), 9)


@query
def calibrated_metrics(spark, d):
    parts = sampling.temporal_split(proxy.scored(spark, d), "observation_month", SPLIT)
    fit = calibration.fit_calibrator(parts["validation"])
    tables = metrics.mapped_metrics(parts["test"], "pd_12m", "default_12m", {"raw": "pd_12m", "calibrated": fit.apply("pd_12m")})
    return rounded(models.compare_models(tables), 8)


@query
def monthly_calibration(spark, d):
    return rounded(
        calibration.monthly_calibration(calibrated(spark, d), "observation_month", "pd_12m", "pd_12m_cal", "default_12m"),
        8,
    )


@query
def log_odds_round_trip(spark, d):
    rows = proxy.scored(spark, d)
    z = log_odds("pd_12m")
    return rounded(rows.select(*KEY, z.alias("z"), from_log_odds(z).alias("p")), 9)


@query
def score_summary(spark, d):
    return rounded(reports.summary(proxy.scored(spark, d), "pd_12m"), 6, total=4)


# ---- drift, samples, preparation ----


@query
def psi_table(spark, d):
    perf, orig, hot = loans(spark, d)
    rows = ecl.portfolio(perf, orig, None, hot)
    rows = materialise(rows.select("observation_month", *DRIFT_FEATURES), "psi")
    parts = sampling.temporal_split(rows, "observation_month", {"train": (None, 1998), "test": (2000, 2001)})
    return rounded(drift.psi(parts["train"], parts["test"], DRIFT_FEATURES), 8)


@query
def psi_scores(spark, d):
    parts = sampling.temporal_split(proxy.scored(spark, d), "observation_month", SPLIT)
    return rounded(drift.psi(parts["train"], parts["test"], ["pd_12m", "p_tie"]), 8)


@query
def temporal_split_counts(spark, d):
    rows = sampling.with_split(proxy.scored(spark, d), "observation_month", SPLIT)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("default_12m").alias("defaults"))


@query
def union_validation_test(spark, d):
    parts = sampling.temporal_split(proxy.scored(spark, d), "observation_month", SPLIT)
    both = parts["validation"].unionByName(parts["test"])
    return rounded(
        metrics.monthly_performance(both, "observation_month", "p_tie", "default_12m"), 8
    )


@query
def stratified_sample(spark, d):
    rows = proxy.scored(spark, d).select(*KEY, "observation_month", "default_12m")
    return sampling.stratified_fraction(rows, "default_12m", 0.4, KEY)


@query
def impute_scale(spark, d):
    rows = materialise(clean.model_data(labelled(spark, d), "score"), "impute")
    numeric, categorical = list(PD_NUMERIC), list(PD_CATEGORICAL)
    imputer = features.fit_imputer(rows, numeric, categorical)
    filled = imputer.transform(rows)
    scaled = features.fit_scaler(filled, numeric).transform(filled)
    return rounded(scaled.select(LOAN, "observation_month", *numeric, *categorical), 6)


@query
def stratified_sample_exact(spark, d):
    rows = proxy.scored(spark, d).select(*KEY, "observation_month", "default_12m")
    return sampling.stratified_sample(rows, "default_12m", 20_000, KEY)


@query
def training_sample(spark, d):
    """Training and validation rows of the published sizes, with their class shares."""
    parts = sampling.temporal_split(proxy.scored(spark, d), "observation_month", SPLIT)
    out = None
    for name, size in (("train", TRAIN_ROWS), ("validation", VALIDATION_ROWS)):
        rows = models.training_rows(parts[name].select(*KEY, "default_12m"), size, KEY)
        part = rows.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def feature_vectors(spark, d):
    """Every slot of the default model's feature vector that is not zero, fitted on the training period."""
    rows = materialise(clean.model_data(labelled(spark, d), "unified", ["record_id"]), "features")
    train = sampling.temporal_split(rows, "observation_month", SPLIT)["train"]
    model = features.build_features(train, "pd")
    return rounded(features.feature_values(model, rows, ROW))


# ---- expected loss ----


def formula_portfolio(spark, d, month: int | None = None) -> DataFrame:
    """Every performance row as part of the portfolio of its month, scored by formula instead of by a model."""
    perf, orig, hot = loans(spark, d)
    if month is None:
        defaults = ecl.last_balance(perf, order=ORDER, hot=hot)
    else:
        before = ym_before(month)
        perf = proxy.performance(spark, d, before, month)
        defaults = ecl.last_balance(perf, before, month, ORDER, hot).where(F.col("observation_month") == month)
    rows = ecl.portfolio(perf, orig, month, hot)
    scored = rows.select("*", F.expr(proxy.FORMULA_PD), F.expr(proxy.FORMULA_LGD))
    return ecl.compute_ecl(ecl.lookup(scored, defaults, ["record_id"]))


def ym_before(month: int) -> int:
    return month - 1 if month % 100 > 1 else month - 89


ECL_COLUMNS = [
    LOAN, "observation_month", "record_id", "months_to_legal_maturity", "stage", "lgd", "ead", "hazard_factor", "ecl",
]


@query
def stage_assignment(spark, d):
    rows = proxy.performance(spark, d).where(is_not("zero_balance_code", 1))
    return ecl.with_stage(rows).select("record_id", "delinquency_bucket", "stage")


@query
def pd_term_structure(spark, d):
    rows = proxy.performance(spark, d).select(
        "months_to_legal_maturity", "current_interest_rate", F.expr(proxy.FORMULA_PD)
    )
    curve = ecl.pd_term_structure(rows, "pd_12m_cal", "months_to_legal_maturity", "current_interest_rate")
    return rounded(
        curve.groupBy("t").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("marginal_pd").alias("marginal_pd"),
            F.avg("cumulative_pd").alias("cumulative_pd"),
            F.avg("discount_factor").alias("discount_factor"),
        ),
        9,
    )


@query
def last_balance(spark, d):
    perf = proxy.performance(spark, d)
    return ecl.last_balance(perf, order=ORDER, hot=hot_keys(perf, LOAN))


@query
def last_balance_snapshot(spark, d):
    before = ym_before(proxy.SNAPSHOT_MONTH)
    perf = proxy.performance(spark, d, before, proxy.SNAPSHOT_MONTH)
    return ecl.last_balance(perf, before, proxy.SNAPSHOT_MONTH, ORDER, hot_keys(perf, LOAN))


@query
def balance_lookup(spark, d):
    perf = proxy.performance(spark, d)
    defaults = ecl.last_balance(perf, order=ORDER, hot=hot_keys(perf, LOAN))
    rows = perf.select(LOAN, F.col(MONTH).alias("observation_month"), "record_id")
    return ecl.lookup(rows, defaults.withColumnRenamed("record_id", "default_record"), ["default_record"])


@query
def combine_scores(spark, d):
    perf = proxy.performance(spark, d)
    rows = perf.withColumnRenamed(MONTH, "observation_month")
    pd_side = rows.select(*ROW, F.expr(proxy.FORMULA_PD))
    lgd_side = rows.select(*ROW, F.expr(proxy.FORMULA_LGD))
    return ecl.combine(pd_side, lgd_side, ROW)


@query
def ecl_portfolio(spark, d):
    return rounded(formula_portfolio(spark, d).select(*ECL_COLUMNS), 9, ead=2, ecl=2)


@query
def ecl_snapshot(spark, d):
    return rounded(
        formula_portfolio(spark, d, proxy.SNAPSHOT_MONTH).select(*ECL_COLUMNS), 9, ead=2, ecl=2
    )


def decile_frame(spark, d) -> DataFrame:
    columns = [LOAN, "pd_12m_cal", "lgd", "ead", "ecl", "stage", "credit_score", "dti", "ltv", "eltv", "loan_age"]
    return reports.with_decile(materialise(formula_portfolio(spark, d).select(*columns), "deciles"))


@query
def decile_profile(spark, d):
    return rounded(reports.decile_profile(decile_frame(spark, d)), mean_ead=2)


@query
def decile_ecl(spark, d):
    return rounded(reports.decile_ecl(decile_frame(spark, d)), mean_ead=2, mean_ecl=2, total_ecl=2)


@query
def stage_ecl(spark, d):
    return rounded(reports.stage_ecl(decile_frame(spark, d)), total_ead=2, total_ecl=2, mean_ecl=2)


# ---- fitted models (no SQL twin) ----

def modelling_rows(spark, d) -> DataFrame:
    return clean.model_data(labelled(spark, d), "unified")


def default_model(spark, d, kind: str) -> DataFrame:
    parts = sampling.temporal_split(modelling_rows(spark, d), "observation_month", SPLIT)
    model = models.fit_pd(parts["train"], kind)
    scored = models.score_pd(model, parts["validation"].unionByName(parts["test"]))
    return rounded(metrics.monthly_performance(scored, "observation_month", "pd_12m", "default_12m"))


def severity_rows(spark, d) -> DataFrame:
    perf, orig, hot = loans(spark, d)
    return sev.severity_dataset(sev.severity_history(perf), orig, hot)


def severity_model(spark, d, kind: str) -> DataFrame:
    parts = sampling.temporal_split(severity_rows(spark, d), "default_month", SPLIT)
    model = models.fit_lgd(parts["train"], kind)
    rows = sampling.with_split(parts["validation"].unionByName(parts["test"]), "default_month", SPLIT)
    scored = materialise(models.score_lgd(model, rows, "lgd_pred", bounded=False), "scored")
    # the rows of the annual table, then of the parts with the correlations
    annual = reports.annual_severity(scored, "observation_month").select(
        F.col("year").cast("string").alias("part"), "mean_actual", "mean_predicted", "rmse", "mae"
    )
    errors = metrics.regression_metrics(scored, "lgd_pred", "lgd_model", ["split"]).drop("observations")
    linked = reports.severity_correlations(scored, ["split"])
    return rounded(annual.unionByName(errors.join(linked, "split").withColumnRenamed("split", "part"), allowMissingColumns=True))


@query
def pd_model_lr(spark, d):
    return default_model(spark, d, "lr")


@query
def pd_model_lr_equations(spark, d):
    """The optimality conditions of the logistic model, one per slot of the feature vector; all 0.

    The slots of unknown levels are 0 in every training row, so the penalty alone holds their slopes at exactly 0.
    """
    train = sampling.temporal_split(modelling_rows(spark, d), "observation_month", SPLIT)["train"]
    train = materialise(models.training_rows(train), "train")
    table = models.score_equations(models.fit_pd(train, "lr"), train)
    return table.select("slot", (F.round("equation", 6) + F.lit(0.0)).alias("equation"))


@query
def saved_models(spark, d):
    """Models of each kind, saved and loaded again: rows scored, and rows whose two scores differ."""
    panel_rows = materialise(modelling_rows(spark, d), "panel")  # the training and the scored rows come from one panel
    parts = sampling.temporal_split(panel_rows, "observation_month", SPLIT)
    train = materialise(models.training_rows(parts["train"]), "train")  # drawn once for all kinds
    rows = parts["validation"].unionByName(parts["test"])
    rows = materialise(rows.withColumn("row_number", F.monotonically_increasing_id()), "rows")
    small = {"lr": {}, "gbt": {"rounds": 6}, "rf": {"trees": 8}}
    out = None
    for kind, settings in small.items():
        model, path = models.fit_pd(train, kind, **settings), own_folder(spark, "model")
        models.save_model(model, path)
        one = models.score_pd(model, rows).select("row_number", "pd_12m")
        two = models.score_pd(models.load_model(path), rows).select("row_number", F.col("pd_12m").alias("again"))
        both = one.join(two, "row_number").where(F.col("pd_12m").between(0, 1))
        part = both.agg(
            F.lit(kind).alias("model"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.abs(F.col("pd_12m") - F.col("again")) > 1e-12).alias("differing"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def model_periods(spark, d):
    """What the data decide about a model run: months, rows and defaults of each part."""
    rows = sampling.with_split(modelling_rows(spark, d), "observation_month", SPLIT)
    return rows.groupBy("split").agg(
        F.min("observation_month").alias("first_month"),
        F.max("observation_month").alias("last_month"),
        F.count(F.lit(1)).alias("n"),
        F.sum("default_12m").alias("defaults"),
    )


@query
def pd_model_gbt(spark, d):
    return default_model(spark, d, "gbt")


@query
def pd_model_rf(spark, d):
    return default_model(spark, d, "rf")


@query
def pd_model_gbt_wide(spark, d):
    return default_model(spark, d, "gbt_wide")


@query
def lgd_model_gbt(spark, d):
    return severity_model(spark, d, "gbt")


@query
def lgd_model_rf(spark, d):
    return severity_model(spark, d, "rf")


@query
def lgd_model_gbt_wide(spark, d):
    return severity_model(spark, d, "gbt_wide")


@query
def ecl_from_models(spark, d):
    """Train, calibrate, score the snapshot month and report expected loss by decile."""
    perf, orig, hot = loans(spark, d)
    rows = modelling_rows(spark, d)
    parts = sampling.temporal_split(rows, "observation_month", {"train": (None, 1998), "calibration": (1999, 2001)})
    pd_model = models.fit_pd(parts["train"], "gbt")
    calibrator = calibration.fit_calibrator(models.score_pd(pd_model, parts["calibration"]))
    lgd_model = models.fit_lgd(severity_rows(spark, d), "gbt")
    month = 200107
    recent = proxy.performance(spark, d, ym_before(month), month)  # the bounds reach the scan
    losses = ecl.portfolio_ecl(recent, orig, pd_model, calibrator, lgd_model, month, ORDER, hot=hot)
    losses = materialise(losses.select(LOAN, "pd_12m_cal", "lgd", "ead", "ecl", "stage"), "ecl")
    return rounded(reports.decile_ecl(reports.with_decile(losses)))
