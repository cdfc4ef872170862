"""Declared schemas of the two raw tables (fixed values: names, order and types of the input files)."""

ORIGINATION = """
credit_score INT,
first_payment_date INT,
first_time_homebuyer_indicator STRING,
maturity_date INT,
msa_code STRING,
mortgage_insurance_pct INT,
number_of_units INT,
occupancy_status STRING,
cltv INT,
dti INT,
upb INT,
ltv INT,
interest_rate DECIMAL(18,6),
channel STRING,
prepayment_penalty_indicator STRING,
amortization_type STRING,
property_state STRING,
property_type STRING,
postal_code INT,
loan_identifier STRING,
loan_purpose STRING,
loan_term INT,
number_of_borrowers INT,
seller_name STRING,
super_conforming_flag STRING,
pre_harp_loan_sequence_number STRING,
special_eligibility_program STRING,
harp_indicator STRING,
property_valuation_method INT,
interest_only_indicator STRING,
vantage_score_4_0 INT
"""

PERFORMANCE = """
loan_identifier STRING,
monthly_reporting_period INT,
current_actual_upb DECIMAL(18,6),
current_loan_delinquency_status STRING,
loan_age INT,
months_to_legal_maturity INT,
underwriting_defect_and_major_servicing_defect_settlement_date INT,
modification_flag STRING,
zero_balance_code INT,
zero_balance_effective_date INT,
current_interest_rate DECIMAL(18,6),
current_non_interest_bearing_upb DECIMAL(18,6),
ddlpi INT,
mi_recoveries DECIMAL(18,6),
net_sales_proceeds DECIMAL(18,6),
non_mi_recoveries DECIMAL(18,6),
total_expenses DECIMAL(18,6),
legal_costs DECIMAL(18,6),
maintenance_and_preservation_costs DECIMAL(18,6),
taxes_and_insurance DECIMAL(18,6),
miscellaneous_expenses DECIMAL(18,6),
actual_loss DECIMAL(18,6),
cumulative_modification_costs DECIMAL(18,6),
interest_rate_step_indicator STRING,
payment_deferral_flag STRING,
eltv INT,
zero_balance_removal_upb DECIMAL(18,6),
delinquent_accrued_interest DECIMAL(18,6),
delinquency_due_to_disaster STRING,
borrower_assistance_plan STRING,
current_period_modification_costs DECIMAL(18,6),
current_interest_bearing_upb DECIMAL(18,6),
mortgage_insurance_cancellation_indicator STRING,
servicer_name STRING,
bankruptcy_cramdown_costs DECIMAL(18,6)
"""


def column_names(schema: str) -> list[str]:
    return [line.split()[0] for line in schema.strip().splitlines()]
