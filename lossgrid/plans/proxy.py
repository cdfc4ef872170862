"""Loan tables derived from the order tables at hand, with the raw tables' column names.

Each view is one SELECT that Spark SQL and DuckDB read alike, so a check in the other engine starts from equal rows. A
customer is a loan; an order is the performance row of its month; missing-value markers, default codes and odd
delinquency codes are made by rule. `record_id` tells several orders of one customer and month apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORIGINATION = """
SELECT
  CAST(CASE WHEN c_custkey % 37 = 0 THEN 9999 ELSE 500 + c_custkey % 350 END AS INT) AS credit_score,
  CAST(199501 + c_custkey % 12 AS INT) AS first_payment_date,
  CASE WHEN c_custkey % 31 = 0 THEN '9' WHEN c_custkey % 5 = 1 THEN 'Y' ELSE 'N' END AS first_time_homebuyer_indicator,
  CAST(202501 + c_custkey % 12 AS INT) AS maturity_date,
  CAST(10000 + c_nationkey AS VARCHAR(5)) AS msa_code,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 35 END AS INT) AS mortgage_insurance_pct,
  CAST(CASE WHEN c_custkey % 43 = 0 THEN 99 WHEN c_custkey % 47 = 0 THEN 9 ELSE 1 + c_custkey % 4 END AS INT)
    AS number_of_units,
  CASE WHEN c_custkey % 29 = 0 THEN '9' WHEN c_custkey % 6 = 1 THEN 'I' WHEN c_custkey % 6 = 2 THEN 'S' ELSE 'P' END
    AS occupancy_status,
  CAST(CASE WHEN c_custkey % 39 = 0 THEN 999 ELSE 30 + c_custkey % 70 END AS INT) AS cltv,
  CAST(CASE WHEN c_custkey % 41 = 0 THEN 999 ELSE 10 + c_custkey % 50 END AS INT) AS dti,
  CAST(50000 + c_custkey * 37 % 400000 AS INT) AS upb,
  CAST(CASE WHEN c_custkey % 53 = 0 THEN 999 ELSE 25 + c_custkey % 70 END AS INT) AS ltv,
  CAST(2 + (c_custkey % 60) / 1e1 AS DOUBLE) AS interest_rate,
  CASE WHEN c_custkey % 59 = 0 THEN '9' ELSE substring(c_mktsegment, 1, 1) END AS channel,
  'N' AS prepayment_penalty_indicator,
  'FRM' AS amortization_type,
  lpad(CAST(c_nationkey AS VARCHAR(2)), 2, '0') AS property_state,
  CASE WHEN c_custkey % 61 = 0 THEN '99' WHEN c_custkey % 3 = 0 THEN 'CO' WHEN c_custkey % 3 = 1 THEN 'PU' ELSE 'SF' END
    AS property_type,
  CAST(10000 + c_custkey % 900 * 100 AS INT) AS postal_code,
  concat('C', lpad(CAST(c_custkey AS VARCHAR(11)), 11, '0')) AS loan_identifier,
  CASE WHEN c_custkey % 67 = 0 THEN '9' WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'C' END AS loan_purpose,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 180 ELSE 360 END AS INT) AS loan_term,
  CAST(CASE WHEN c_custkey % 71 = 0 THEN 99 ELSE 1 + c_custkey % 2 END AS INT) AS number_of_borrowers,
  concat('SELLER ', CAST(c_custkey % 20 AS VARCHAR(2))) AS seller_name,
  CASE WHEN c_custkey % 9 = 0 THEN 'Y' END AS super_conforming_flag,
  CAST(NULL AS VARCHAR(12)) AS pre_harp_loan_sequence_number,
  CASE WHEN c_custkey % 10 = 0 THEN 'H' ELSE '9' END AS special_eligibility_program,
  CASE WHEN c_custkey % 50 = 0 THEN 'Y' END AS harp_indicator,
  CAST(1 + c_custkey % 4 AS INT) AS property_valuation_method,
  'N' AS interest_only_indicator,
  CAST(CASE WHEN c_custkey % 33 = 0 THEN 9999 ELSE 510 + c_custkey % 340 END AS INT) AS vantage_score_4_0
FROM {customer}
"""

# the two conditions that make an order a default row
_DEFAULT = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
_YM = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)"
_CODE = (
    f"CAST(CASE WHEN {_DEFAULT} THEN CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 9 END "
    "WHEN o_orderkey % 17 = 0 THEN 1 END AS INT)"
)
_COSTS = "CAST(CASE WHEN {default} THEN o_totalprice * {share} END AS DOUBLE)"


def _cost(share: str) -> str:
    return _COSTS.format(default=_DEFAULT, share=share)


PERFORMANCE = f"""
SELECT
  concat('C', lpad(CAST(o_custkey AS VARCHAR(11)), 11, '0')) AS loan_identifier,
  {_YM} AS monthly_reporting_period,
  CAST(CASE WHEN {_DEFAULT} THEN 0 ELSE o_totalprice END AS DOUBLE) AS current_actual_upb,
  CASE WHEN o_orderkey % 11 = 0 THEN 'XX' WHEN o_orderkey % 13 = 0 THEN 'RA'
    ELSE CAST(o_orderkey % 5 AS VARCHAR(2)) END AS current_loan_delinquency_status,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS loan_age,
  CAST(o_orderkey % 361 - 12 AS INT) AS months_to_legal_maturity,
  CAST(NULL AS INT) AS underwriting_defect_and_major_servicing_defect_settlement_date,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Y' WHEN o_orderkey % 7 = 1 THEN 'P' END AS modification_flag,
  {_CODE} AS zero_balance_code,
  CASE WHEN {_CODE} IS NOT NULL THEN {_YM} END AS zero_balance_effective_date,
  CAST(2 + (o_orderkey % 60) / 1e1 AS DOUBLE) AS current_interest_rate,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice * 5e-2 ELSE 0 END AS DOUBLE) AS current_non_interest_bearing_upb,
  {_YM} AS ddlpi,
  {_cost("2e-2")} AS mi_recoveries,
  {_cost("6e-1")} AS net_sales_proceeds,
  {_cost("1e-2")} AS non_mi_recoveries,
  {_cost("8e-2")} AS total_expenses,
  {_cost("2e-2")} AS legal_costs,
  {_cost("3e-2")} AS maintenance_and_preservation_costs,
  {_cost("2e-2")} AS taxes_and_insurance,
  {_cost("1e-2")} AS miscellaneous_expenses,
  CAST(CASE WHEN {_DEFAULT} AND o_orderkey % 23 <> 0 THEN o_totalprice * ((o_orderkey % 130) / 1e2 - 2e-1) END AS DOUBLE)
    AS actual_loss,
  CAST(0 AS DOUBLE) AS cumulative_modification_costs,
  CAST(NULL AS VARCHAR(1)) AS interest_rate_step_indicator,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Y' END AS payment_deferral_flag,
  CAST(CASE WHEN o_orderkey % 29 = 0 THEN 999 ELSE 20 + o_orderkey % 90 END AS INT) AS eltv,
  CAST(CASE WHEN {_DEFAULT} THEN o_totalprice END AS DOUBLE) AS zero_balance_removal_upb,
  CAST(CASE WHEN {_DEFAULT} AND o_orderkey % 19 <> 0 THEN o_totalprice * (o_orderkey % 8) / 1e2 END AS DOUBLE)
    AS delinquent_accrued_interest,
  CASE WHEN o_orderkey % 101 = 0 THEN 'Y' END AS delinquency_due_to_disaster,
  CASE WHEN o_orderkey % 14 = 0 THEN 'F' WHEN o_orderkey % 14 = 1 THEN 'R' END AS borrower_assistance_plan,
  CAST(0 AS DOUBLE) AS current_period_modification_costs,
  CAST(CASE WHEN {_DEFAULT} THEN 0 ELSE o_totalprice END AS DOUBLE) AS current_interest_bearing_upb,
  CAST(NULL AS VARCHAR(1)) AS mortgage_insurance_cancellation_indicator,
  concat('SERVICER ', CAST(o_orderkey % 25 AS VARCHAR(2))) AS servicer_name,
  CAST(0 AS DOUBLE) AS bankruptcy_cramdown_costs,
  o_orderkey AS record_id
FROM {{orders}}
"""

# scores with almost no ties (pd_12m) and with many (p_tie)
SCORED = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS observation_month,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS default_12m,
  CAST((l_extendedprice + 1) / 2e5 AS DOUBLE) AS pd_12m,
  CAST((l_discount + 1e-2) / 2e-1 AS DOUBLE) AS p_tie
FROM {lineitem}
"""

SEVERITY = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS observation_month,
  CASE WHEN l_quantity = 1 THEN NULL ELSE l_extendedprice * l_tax END AS delinquent_accrued_interest,
  l_extendedprice AS zero_balance_removal_upb,
  l_extendedprice * (l_discount * 15 - 2e-1) AS actual_loss,
  l_discount * 10 AS lgd_pred
FROM {lineitem}
"""

# default probability and severity by formula, for the loss queries that do not fit a model
FORMULA_PD = "CAST(5e-4 + (record_id % 997) / 2e4 AS DOUBLE) AS pd_12m_cal"
FORMULA_LGD = (
    "CAST(CASE WHEN record_id % 130 < 10 THEN 0 WHEN record_id % 130 > 110 THEN 1 "
    "ELSE (record_id % 130 - 10) / 1e2 END AS DOUBLE) AS lgd"
)

SNAPSHOT_MONTH = 199803
CUTOFF_MONTH = 200008


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORIGINATION, customer=load(spark, sf_dir, "customer"))


def performance(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All performance rows, or those of an inclusive range of months, whose dates are then bounded in the scan."""
    orders = load(spark, sf_dir, "orders")
    if first is not None:
        orders = orders.where(f"o_orderdate >= DATE'{first // 100}-{first % 100:02d}-01'")
    if last is not None:
        after = last + 1 if last % 100 < 12 else (last // 100 + 1) * 100 + 1
        orders = orders.where(f"o_orderdate < DATE'{after // 100}-{after % 100:02d}-01'")
    return spark.sql(PERFORMANCE, orders=orders)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED, lineitem=load(spark, sf_dir, "lineitem"))


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEVERITY, lineitem=load(spark, sf_dir, "lineitem"))


def duckdb_views() -> dict[str, str]:
    """The same views over the plain table names."""
    return {
        "v_orig": ORIGINATION.format(customer="customer"),
        "v_perf": PERFORMANCE.format(orders="orders"),
        "v_scored": SCORED.format(lineitem="lineitem"),
        "v_severity": SEVERITY.format(lineitem="lineitem"),
    }
