"""Results only agree with the published ones if these stay as they are."""

# termination codes that count as default, and the code of a loan that simply ended
DEFAULT_CODES = (2, 3, 9)
PREPAID_CODE = 1

HORIZON_MONTHS = 12
LAST_OBSERVABLE_MONTH = 202503
PORTFOLIO_MONTH = 202603

# "missing" markers per column, one profile per use
SENTINELS = {
    "train": {
        "credit_score": (9999,),
        "number_of_units": (99,),
        "cltv": (999,),
        "dti": (999,),
        "ltv": (999,),
        "number_of_borrowers": (99,),
        "eltv": (999,),
    },
    "lgd": {
        "credit_score": (9999,),
        "number_of_units": (99,),
        "cltv": (999,),
        "dti": (999,),
        "ltv": (999,),
        "eltv": (999,),
    },
    "score": {
        "credit_score": (9999,),
        "mortgage_insurance_pct": (0,),
        "number_of_units": (9,),
        "cltv": (999,),
        "dti": (999,),
        "ltv": (999,),
        "number_of_borrowers": (99,),
        "first_time_homebuyer_indicator": ("9",),
        "occupancy_status": ("9",),
        "channel": ("9",),
        "property_type": ("99",),
        "loan_purpose": ("9",),
        "eltv": (999,),
        "current_loan_delinquency_status": ("XX",),
    },
    "unified": {
        "credit_score": (9999,),
        "number_of_units": (9, 99),
        "cltv": (999,),
        "dti": (999,),
        "ltv": (999,),
        "number_of_borrowers": (99,),
        "first_time_homebuyer_indicator": ("9",),
        "occupancy_status": ("9",),
        "channel": ("9",),
        "property_type": ("99",),
        "loan_purpose": ("9",),
        "eltv": (999,),
        "current_loan_delinquency_status": ("XX",),
    },
}

# feature lists
PD_NUMERIC = (
    "credit_score", "mortgage_insurance_pct", "number_of_units", "cltv", "dti", "original_upb", "ltv", "interest_rate",
    "loan_term", "number_of_borrowers", "current_actual_upb", "current_interest_rate",
    "current_non_interest_bearing_upb", "eltv", "delinquency_status_numeric",
)
PD_CATEGORICAL = (
    "first_time_homebuyer_indicator", "occupancy_status", "channel", "property_state", "property_type",
    "loan_purpose", "modification_flag", "payment_deferral_flag",
)
LGD_NUMERIC = (
    "eltv", "ltv", "cltv", "current_actual_upb", "loan_age", "credit_score", "dti", "interest_rate",
    "current_interest_rate",
)
LGD_CATEGORICAL = ("current_loan_delinquency_status", "property_state")
DRIFT_FEATURES = (
    "credit_score", "mortgage_insurance_pct", "number_of_units", "cltv", "dti", "original_upb", "ltv", "interest_rate",
    "loan_term", "number_of_borrowers", "loan_age", "months_to_legal_maturity", "current_actual_upb",
    "current_interest_rate", "current_non_interest_bearing_upb", "eltv", "delinquency_status_numeric",
)
CORRELATION_COLUMNS = (
    "eltv", "ltv", "cltv", "current_actual_upb", "loan_age", "credit_score", "dti", "interest_rate",
    "current_interest_rate", "lgd_model",
)
CORRELATION_LAST_MONTH = 202112

# severity: features of the month before default, target columns, static loan attributes
SEVERITY_FEATURES = (
    "observation_month", "current_actual_upb", "current_loan_delinquency_status", "loan_age", "current_interest_rate",
    "eltv", "modification_flag", "payment_deferral_flag",
)
SEVERITY_FLAGS = ("modification_flag", "payment_deferral_flag")
SEVERITY_TARGETS = (
    "zero_balance_code", "zero_balance_effective_date", "delinquent_accrued_interest", "zero_balance_removal_upb",
    "actual_loss",
)
SEVERITY_LOAN_ATTRIBUTES = (
    "credit_score", "mortgage_insurance_pct", "number_of_units", "occupancy_status", "cltv", "dti", "upb", "ltv",
    "interest_rate", "channel", "property_state", "loan_purpose", "loan_term",
)

# sampling, splits, calibration, ranking
SEED = 42
TRAIN_ROWS = 4_000_000
VALIDATION_ROWS = 800_000
PROBABILITY_FLOOR = 1e-15
CALIBRATION_C = 1e6
TOP_PERCENTS = (1, 5, 10, 20, 30, 50)

# delinquency buckets that move a loan to stage 2
LATE_BUCKETS = ("30-59", "60-89", "90-119", "120+")

# population stability: bins of the reference sample and the smallest share a bin may have
PSI_BINS = 10
PSI_SHARE_FLOOR = 1e-6
