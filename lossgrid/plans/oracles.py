"""DuckDB SQL twins of the registered queries, over the same proxy views."""

from __future__ import annotations

import re

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
from lossgrid.plans import proxy
from lossgrid.sources.schemas import ORIGINATION, PERFORMANCE, column_names

VIEWS = proxy.duckdb_views()
CUTOFF, SNAPSHOT = proxy.CUTOFF_MONTH, proxy.SNAPSHOT_MONTH
LATE = "('30-59', '60-89', '90-119', '120+')"
ORACLES: dict[str, str] = {}


def twin(name: str, body: str, **parts: str) -> None:
    """Register `body`, preceded by the views and helper tables it mentions."""
    tables = {**VIEWS, **HELPERS, **parts}
    needed: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for table in dict.fromkeys(re.findall(r"\b[tv]_\w+", text)):
            if table in tables and table not in needed and table not in inside:
                visit(tables[table], (*inside, table))
                needed.append(table)

    visit(body)
    recursive = "RECURSIVE " if any("UNION ALL SELECT k + 1" in tables[t] for t in needed) else ""
    head = ",\n".join(f"{t} AS ({tables[t].strip()})" for t in needed)
    ORACLES[name] = f"WITH {recursive}{head}\n{body.strip()}" if needed else body.strip()


def cleaned(column: str, profile: str, name: str | None = None) -> str:
    text = column
    for marker in SENTINELS[profile].get(name or column, ()):
        text = f"NULLIF({text}, {marker!r})"
    return text


def idx(ym: str) -> str:
    return f"({ym} // 100 * 12 + {ym} % 100)"


def ym_minus_one(ym: str) -> str:
    return f"(CASE WHEN {ym} % 100 = 1 THEN {ym} - 89 ELSE {ym} - 1 END)"


def split_of(ym: str) -> str:
    return (
        f"CASE WHEN {ym} <= 199812 THEN 'train' WHEN {ym} <= 199912 THEN 'validation' "
        f"WHEN {ym} <= 200112 THEN 'test' END"
    )


STATUS = (
    "CASE WHEN regexp_matches(current_loan_delinquency_status, '^[0-9]+$') "
    "THEN TRY_CAST(current_loan_delinquency_status AS INT) END"
)
BUCKET = (
    f"CASE ({STATUS}) WHEN 0 THEN 'current' WHEN 1 THEN '30-59' WHEN 2 THEN '60-89' WHEN 3 THEN '90-119' "
    f"ELSE CASE WHEN ({STATUS}) >= 4 THEN '120+' END END"
)
_ORIG_COLUMNS = [c for c in column_names(ORIGINATION) if c not in ("loan_identifier", "upb")]
_PERF_COLUMNS = [c for c in column_names(PERFORMANCE) if c not in ("loan_identifier", "monthly_reporting_period")]
_PERF_SELECT = ", ".join(f"p.{c}" for c in _PERF_COLUMNS)
_ORIG_SELECT = ", ".join(f"o.{c}" for c in _ORIG_COLUMNS)

HELPERS = {
    "t_events": """
        SELECT loan_identifier, monthly_reporting_period AS default_date, zero_balance_code AS default_code
        FROM v_perf WHERE zero_balance_code IN (2, 3, 9)""",
    "t_first": "SELECT loan_identifier, min(default_date) AS default_date FROM t_events GROUP BY 1",
    "t_panel": f"""
        SELECT p.loan_identifier, p.monthly_reporting_period AS observation_month, p.record_id, {_PERF_SELECT},
          {_ORIG_SELECT}, o.upb AS original_upb,
          CASE WHEN d.default_date > p.monthly_reporting_period
                AND {idx("d.default_date")} <= {idx("p.monthly_reporting_period")} + 12 THEN 1 ELSE 0 END AS default_12m
        FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier
        LEFT JOIN t_first d ON p.loan_identifier = d.loan_identifier
        WHERE p.monthly_reporting_period <= {CUTOFF}
          AND (d.default_date IS NULL OR p.monthly_reporting_period < d.default_date)""",
    "t_panel_all": f"""
        SELECT p.loan_identifier, p.monthly_reporting_period AS observation_month, p.record_id, o.upb AS original_upb,
          CASE WHEN d.default_date > p.monthly_reporting_period
                AND {idx("d.default_date")} <= {idx("p.monthly_reporting_period")} + 12 THEN 1 ELSE 0 END AS default_12m
        FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier
        LEFT JOIN t_events d ON p.loan_identifier = d.loan_identifier
        WHERE p.monthly_reporting_period <= {CUTOFF}
          AND (d.default_date IS NULL OR p.monthly_reporting_period < d.default_date)""",
    "t_history": f"""
        SELECT p.*, p.monthly_reporting_period AS observation_month, d.default_date AS default_month,
          CASE WHEN p.monthly_reporting_period = d.default_date THEN 'default_month'
            ELSE '1_month_before' END AS observation_type
        FROM v_perf p JOIN t_events d ON p.loan_identifier = d.loan_identifier
        WHERE p.monthly_reporting_period IN (d.default_date, {ym_minus_one("d.default_date")})""",
    "t_targets": """
        SELECT loan_identifier, default_month, sum(delinquent_accrued_interest + zero_balance_removal_upb) AS ead,
          sum(actual_loss) AS loss
        FROM (SELECT DISTINCT loan_identifier, default_month, record_id, delinquent_accrued_interest,
                zero_balance_removal_upb, actual_loss
              FROM t_history
              WHERE observation_type = 'default_month' AND delinquent_accrued_interest IS NOT NULL
                AND actual_loss IS NOT NULL AND zero_balance_removal_upb IS NOT NULL)
        GROUP BY 1, 2""",
    "t_severity": """
        SELECT *, least(greatest(actual_loss / (delinquent_accrued_interest + zero_balance_removal_upb), 0), 1)
          AS lgd_model
        FROM v_severity
        WHERE delinquent_accrued_interest IS NOT NULL AND actual_loss IS NOT NULL AND zero_balance_removal_upb IS NOT NULL""",
    "t_lagged": """
        SELECT loan_identifier, monthly_reporting_period, record_id, zero_balance_code, current_actual_upb,
          lag(current_actual_upb) OVER w AS last_upb, lag(monthly_reporting_period) OVER w AS last_month
        FROM v_perf WINDOW w AS (PARTITION BY loan_identifier ORDER BY monthly_reporting_period, record_id)""",
    "t_last": f"""
        SELECT loan_identifier, monthly_reporting_period AS observation_month, record_id, last_upb
        FROM t_lagged
        WHERE zero_balance_code IN (2, 3, 9) AND current_actual_upb = 0 AND last_upb IS NOT NULL
          AND {idx("monthly_reporting_period")} - {idx("last_month")} <= 1""",
    "t_ecl": f"""
        SELECT *, 1 - pow(1 - pd_12m_cal, 1e0 / 12) AS hazard_factor,
          CASE WHEN stage = 3 THEN lgd * ead
            WHEN months_to_legal_maturity = 0 OR stage = 1 THEN pd_12m_cal * lgd * ead
            ELSE lgd * ead * list_sum(list_transform(range(1, months_to_legal_maturity + 1), lambda t:
              (1 - pow(1 - pd_12m_cal, 1e0 / 12)) * pow(pow(1 - pd_12m_cal, 1e0 / 12), t - 1)
              * pow(1 + interest_rate / 100, -t / 12e0))) END AS ecl
        FROM (
          SELECT * EXCLUDE (last_upb, current_actual_upb),
            CASE WHEN stage = 3 THEN last_upb ELSE current_actual_upb END AS ead
          FROM (
            SELECT p.loan_identifier, p.monthly_reporting_period AS observation_month, p.record_id,
              CASE WHEN months_to_legal_maturity < 0 THEN 0 ELSE months_to_legal_maturity END
                AS months_to_legal_maturity,
              CASE WHEN zero_balance_code IN (2, 3, 9) THEN 3 WHEN ({BUCKET}) IN {LATE} THEN 2 ELSE 1 END AS stage,
              {proxy.FORMULA_PD.replace("record_id", "p.record_id")},
              {proxy.FORMULA_LGD.replace("record_id", "p.record_id")},
              o.interest_rate, p.current_actual_upb, b.last_upb, p.loan_age,
              {cleaned("credit_score", "score")} AS credit_score, {cleaned("dti", "score")} AS dti,
              {cleaned("ltv", "score")} AS ltv, {cleaned("eltv", "score")} AS eltv
            FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier
            LEFT JOIN (SELECT loan_identifier, observation_month, arg_max(last_upb, record_id) AS last_upb
                       FROM t_last GROUP BY 1, 2) b
              ON p.loan_identifier = b.loan_identifier AND p.monthly_reporting_period = b.observation_month
            WHERE zero_balance_code IS NULL OR zero_balance_code <> 1))""",
}


def edges_sql(table: str, column: str, q: int) -> str:
    """Distinct quantile edges as a sorted list, by the order statistics around each position."""
    return f"""
        SELECT list(DISTINCT e ORDER BY e) AS edges FROM (
          SELECT CASE WHEN low = high THEN low WHEN f >= 0.5 THEN high - (high - low) * (1 - f)
                   ELSE low + (high - low) * f END AS e
          FROM (
            SELECT i, any_value(pos - floor(pos)) AS f,
              max(CASE WHEN rn = floor(pos) THEN x END) AS low, max(CASE WHEN rn = ceil(pos) THEN x END) AS high
            FROM (SELECT CAST({column} AS DOUBLE) AS x, row_number() OVER (ORDER BY {column}) - 1 AS rn,
                    count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL),
                 (SELECT i, i / CAST({q} AS DOUBLE) AS p FROM range(0, {q} + 1) r(i)) g,
                 LATERAL (SELECT (n - 1) * p AS pos) l
            WHERE rn IN (floor(pos), ceil(pos))
            GROUP BY i))"""


def bin_sql(column: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e < {column}))"


def score_table(table: str, p: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    return f"""
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT {group}{p} AS p, sum(default_12m) AS pos, count(*) - sum(default_12m) AS neg
              FROM {table} GROUP BY {group}{p})
        WINDOW w AS ({part} ORDER BY p DESC)"""


def metric_columns(p: str = "p") -> dict[str, str]:
    n, pos = "sum(pos + neg)", "sum(pos)"
    both = f"{pos} > 0 AND {pos} < {n}"
    q = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
    return {
        "observations": f"CAST({n} AS BIGINT)",
        "defaults": f"CAST({pos} AS BIGINT)",
        "actual_default_rate": f"round({pos} / {n}, 8)",
        "avg_predicted_probability": f"round(sum((pos + neg) * {p}) / {n}, 8)",
        "min_predicted": f"round(min({p}), 8)",
        "max_predicted": f"round(max({p}), 8)",
        "roc_auc": f"round(CASE WHEN {both} THEN sum(neg * (tp - pos + pos / 2)) / ({pos} * ({n} - {pos})) END, 8)",
        "pr_auc": f"round(CASE WHEN {both} THEN sum(pos * tp / (tp + fp)) / {pos} END, 8)",
        "brier": f"round(sum(pos * pow(1 - {p}, 2) + neg * pow({p}, 2)) / {n}, 8)",
        "log_loss": f"round(sum(-(pos * ln({q}) + neg * ln(1 - {q}))) / {n}, 8)",
    }


def select_metrics(names: list[str] | None = None) -> str:
    columns = metric_columns()
    return ", ".join(f"{columns[c]} AS {c}" for c in names or columns)


MONTHLY = ["defaults", "observations", "avg_predicted_probability", "actual_default_rate", "roc_auc", "pr_auc"]

# ---- panel ----

twin("default_events", "SELECT * FROM t_events")
twin(
    "origination_attach",
    f"""SELECT p.loan_identifier, p.monthly_reporting_period, p.record_id, p.current_actual_upb,
      {cleaned("credit_score", "train")} AS credit_score, {cleaned("dti", "train")} AS dti, o.upb AS original_upb,
      o.property_state AS state
    FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier""",
)
twin(
    "pd_panel_first",
    """SELECT loan_identifier, observation_month, record_id, credit_score, original_upb, current_actual_upb, default_12m
    FROM t_panel""",
)
twin(
    "pd_panel_all",
    """SELECT loan_identifier, observation_month, record_id, original_upb, default_12m, count(*) AS copies
    FROM t_panel_all GROUP BY ALL""",
)


def _model_columns(columns, profile: str) -> str:
    return ", ".join(
        f"({STATUS}) AS {c}" if c == "delinquency_status_numeric" else f"{cleaned(c, profile)} AS {c}" for c in columns
    )


twin(
    "feature_typing",
    f"""SELECT loan_identifier, observation_month, default_12m,
      {_model_columns([*PD_NUMERIC, "loan_age", "months_to_legal_maturity", *PD_CATEGORICAL], "train")} FROM t_panel""",
)
twin(
    "feature_load",
    f"""SELECT loan_identifier, observation_month,
      {_model_columns([*PD_NUMERIC, "loan_age", "months_to_legal_maturity"], "train")}, default_12m FROM t_panel""",
)
_marked = [c for c in column_names(ORIGINATION) if any(c in rules for rules in SENTINELS.values())]
twin(
    "sentinel_profiles",
    "\nUNION ALL\n".join(
        f"SELECT loan_identifier, {', '.join(f'{cleaned(c, p)} AS {c}' for c in _marked)}, '{p}' AS profile FROM v_orig"
        for p in SENTINELS
    ),
)
twin(
    "snapshot_month",
    f"""SELECT loan_identifier, monthly_reporting_period, record_id, current_actual_upb, zero_balance_code
    FROM v_perf WHERE monthly_reporting_period = {SNAPSHOT}""",
)
twin(
    "month_range",
    """SELECT loan_identifier, monthly_reporting_period, record_id, current_actual_upb
    FROM v_perf WHERE monthly_reporting_period BETWEEN 199802 AND 199803""",
)
twin(
    "observable_rows",
    f"""SELECT monthly_reporting_period, count(*) AS n FROM v_perf
    WHERE strptime(CAST(monthly_reporting_period AS VARCHAR), '%Y%m') <= DATE '{CUTOFF // 100}-{CUTOFF % 100:02d}-01'
    GROUP BY 1""",
)
twin(
    "month_arithmetic",
    """SELECT record_id, CAST(year(m) AS INT) AS year,
      CAST(strftime(m - INTERVAL 1 MONTH, '%Y%m') AS INT) AS month_before,
      CAST(strftime(m + INTERVAL 12 MONTH, '%Y%m') AS INT) AS year_later,
      strftime(m, '%Y-%m-%d') AS first_day, monthly_reporting_period AS same_month
    FROM (SELECT *, strptime(CAST(monthly_reporting_period AS VARCHAR), '%Y%m') AS m FROM v_perf)""",
)
twin(
    "status_codes",
    f"""SELECT record_id, {STATUS} AS months_behind, {BUCKET} AS bucket FROM v_perf
    WHERE zero_balance_code IS DISTINCT FROM 1""",
)
for _name, _table in (("monthly_default_rate", "t_panel"), ("monthly_default_rate_all_events", "t_panel_all")):
    twin(
        _name,
        f"""SELECT observation_month, count(*) AS observations, CAST(sum(default_12m) AS BIGINT) AS defaults,
          round(avg(default_12m), 9) AS actual_default_rate
        FROM {_table} AS x GROUP BY 1""".replace(" AS x ", " "),
    )

# ---- severity ----

twin(
    "severity_history",
    """SELECT loan_identifier, observation_month, default_month, count(*) AS event_records, observation_type, record_id,
      NULLIF(eltv, 999) AS eltv, current_actual_upb, zero_balance_code, modification_flag, borrower_assistance_plan
    FROM t_history GROUP BY ALL""",
)
twin(
    "severity_dataset",
    f"""SELECT b.loan_identifier, b.default_month, b.record_id, b.observation_month, b.eltv, b.modification_flag,
      b.payment_deferral_flag, {cleaned("credit_score", "lgd")} AS credit_score, {cleaned("ltv", "lgd")} AS ltv,
      round(t.ead, 2) AS ead, round(t.loss / t.ead, 6) AS lgd, round(least(greatest(t.loss / t.ead, 0), 1), 6) AS lgd_model
    FROM (SELECT DISTINCT loan_identifier, default_month, record_id, observation_month, NULLIF(eltv, 999) AS eltv,
            coalesce(modification_flag, 'None') AS modification_flag,
            coalesce(payment_deferral_flag, 'None') AS payment_deferral_flag
          FROM t_history WHERE observation_type = '1_month_before') b
    JOIN t_targets t ON b.loan_identifier = t.loan_identifier AND b.default_month = t.default_month
    JOIN v_orig o ON b.loan_identifier = o.loan_identifier""",
)
twin(
    "severity_dataset_repeated",
    """SELECT b.loan_identifier, b.default_month, b.record_id, round(ead, 2) AS ead, round(loss / ead, 6) AS lgd,
      round(least(greatest(loss / ead, 0), 1), 6) AS lgd_model, parts
    FROM (SELECT DISTINCT loan_identifier, default_month, record_id FROM t_history
          WHERE observation_type = '1_month_before') b
    JOIN (SELECT loan_identifier, default_month, delinquent_accrued_interest + zero_balance_removal_upb AS ead,
            actual_loss AS loss, count(*) AS parts
          FROM t_history WHERE observation_type = 'default_month' AND delinquent_accrued_interest IS NOT NULL
            AND actual_loss IS NOT NULL AND zero_balance_removal_upb IS NOT NULL
          GROUP BY loan_identifier, default_month, zero_balance_code, zero_balance_effective_date,
            delinquent_accrued_interest, zero_balance_removal_upb, actual_loss) t
      ON b.loan_identifier = t.loan_identifier AND b.default_month = t.default_month
    JOIN v_orig o ON b.loan_identifier = o.loan_identifier""",
)
twin(
    "severity_keys",
    """SELECT DISTINCT loan_identifier, default_month, record_id FROM t_history
    WHERE observation_type = '1_month_before'
      AND (loan_identifier, default_month) IN (SELECT (loan_identifier, default_month) FROM t_targets)""",
)
twin(
    "realised_severity",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(delinquent_accrued_interest + zero_balance_removal_upb, 4) AS ead,
      round(actual_loss / (delinquent_accrued_interest + zero_balance_removal_upb), 9) AS lgd,
      round(lgd_model, 9) AS lgd_model
    FROM t_severity""",
)
_errors = "sqrt(avg(pow(lgd_pred - lgd_model, 2)))", "avg(abs(lgd_pred - lgd_model))"
twin(
    "regression_metrics",
    f"""SELECT count(*) AS observations, round(avg(lgd_pred), 6) AS mean_predicted, round(avg(lgd_model), 6) AS mean_actual,
      round({_errors[0]}, 6) AS rmse, round({_errors[1]}, 6) AS mae FROM t_severity""",
)
_ANNUAL = f"""SELECT CAST(observation_month // 100 AS INT) AS year, round(avg(lgd_model), 6) AS mean_actual,
      round(avg(lgd_pred), 6) AS mean_predicted, round({_errors[0]}, 6) AS rmse, round({_errors[1]}, 6) AS mae"""
twin("annual_severity", f"{_ANNUAL} FROM t_severity GROUP BY 1")
twin(
    "mean_severity_baseline",
    f"""{_ANNUAL} FROM (SELECT observation_month, lgd_model,
      (SELECT avg(lgd_model) FROM t_severity WHERE observation_month <= 199812) AS lgd_pred FROM t_severity
      WHERE observation_month BETWEEN 199901 AND 200112) GROUP BY 1""",
)
twin(
    "severity_quantiles",
    """SELECT year, risk_group, CAST(p AS DOUBLE) AS prob,
      round(CASE p WHEN 0.25 THEN quantile_cont(lgd_model, 0.25) WHEN 0.5 THEN quantile_cont(lgd_model, 0.5)
                   ELSE quantile_cont(lgd_model, 0.75) END, 6) AS quantile
    FROM t_binned, unnest([0.25, 0.5, 0.75]) u(p) GROUP BY year, risk_group, p""",
    t_binned=f"""SELECT lgd_model, observation_month // 100 AS year, CAST({bin_sql("lgd_pred", "edges")} AS INT) AS risk_group
        FROM t_severity, t_edges""",
    t_edges=edges_sql("t_severity", "lgd_pred", 5),
)
twin(
    "severity_buckets",
    f"""SELECT CAST({bin_sql("lgd_pred", "edges")} AS INT) AS risk_group, count(*) AS observations,
      round(avg(lgd_pred), 6) AS mean_predicted_lgd, round(avg(lgd_model), 6) AS mean_actual_lgd,
      round(median(lgd_model), 6) AS median_actual_lgd
    FROM t_severity, t_edges GROUP BY 1""",
    t_edges=edges_sql("t_severity", "lgd_pred", 5),
)
# two-sided p-value of a correlation: the regularised incomplete beta function by its continued fraction
_P_VALUE = {
    "t_beta": """
        SELECT n, r, front, below, CASE WHEN below THEN a ELSE 5e-1 END AS aa, CASE WHEN below THEN 5e-1 ELSE a END AS bb,
          CASE WHEN below THEN x ELSE 1 - x END AS xx
        FROM (SELECT *, x < (a + 1) / (a + 25e-1) AS below,
                exp(lgamma(a + 5e-1) - lgamma(a) - lgamma(5e-1) + a * ln(x) + 5e-1 * ln(1 - x)) AS front
              FROM (SELECT n, r, (n - 2) / 2e0 AS a, 1 - r * r AS x FROM t_correlation))""",
    "t_fraction": """
        SELECT 0 AS k, 1e0 AS c, 1 / (1 - (aa + bb) * xx / (aa + 1)) AS d, 1 / (1 - (aa + bb) * xx / (aa + 1)) AS h, aa, bb, xx
        FROM t_beta
        UNION ALL SELECT k + 1, 1 + o / c, 1 / (1 + o * d), h * (1 + o / c) / (1 + o * d), aa, bb, xx
        FROM (SELECT k, aa, bb, xx, 1 + e / c AS c, 1 / (1 + e * d) AS d, h * (1 + e / c) / (1 + e * d) AS h,
                -(aa + k + 1) * (aa + bb + k + 1) * xx / ((aa + 2 * k + 2) * (aa + 2 * k + 3)) AS o
              FROM (SELECT *, (k + 1) * (bb - k - 1) * xx / ((aa + 2 * k + 1) * (aa + 2 * k + 2)) AS e FROM t_fraction
                    WHERE k < 300))""",
}
_P_SELECT = """SELECT n AS observations, round(r, 6) AS correlation,
      round(CASE WHEN below THEN front * h / aa ELSE 1 - front * h / aa END, 6) AS p_value
    FROM t_beta, (SELECT h FROM t_fraction WHERE k = 300)"""
twin(
    "pearson_correlation",
    _P_SELECT,
    **_P_VALUE,
    t_correlation="SELECT count(*) AS n, corr(lgd_pred, lgd_model) AS r FROM t_severity",
)
_P_BY_ID = {
    "t_beta": _P_VALUE["t_beta"].replace("SELECT n, r,", "SELECT id, n, r,").replace("1 - r * r", "greatest(1 - r * r, 1e-300)"),
    "t_fraction": _P_VALUE["t_fraction"].replace("aa, bb, xx\n        FROM", "aa, bb, xx, id\n        FROM").replace("SELECT k, aa,", "SELECT k, id, aa,"),
}
twin(
    "severity_correlations",
    """SELECT year, p.n AS observations, round(p.r, 6) AS pearson, round(s.r, 6) AS spearman,
      round(p.chance, 6) AS pearson_p, round(s.chance, 6) AS spearman_p
    FROM t_chances p JOIN t_chances s ON s.id = p.id + 1 JOIN (SELECT DISTINCT year FROM t_years) ON p.id = year * 2""",
    **_P_BY_ID,
    t_chances="""
        SELECT b.id, n, r, CASE WHEN n >= 3 THEN CASE WHEN below THEN front * h / b.aa ELSE 1 - front * h / b.aa END END AS chance
        FROM t_beta b JOIN t_fraction f ON f.id = b.id AND f.k = 300""",
    t_years="SELECT *, observation_month // 100 AS year FROM t_severity WHERE lgd_pred IS NOT NULL AND lgd_model IS NOT NULL",
    t_correlation="""
        SELECT year * 2 AS id, count(*) AS n, corr(lgd_pred, lgd_model) AS r FROM t_years GROUP BY year
        UNION ALL SELECT year * 2 + 1, count(*), corr(ra, rb) FROM (
          SELECT year, rank() OVER (PARTITION BY year ORDER BY lgd_pred) + (count(*) OVER (PARTITION BY year, lgd_pred) - 1) / 2e0 AS ra,
            rank() OVER (PARTITION BY year ORDER BY lgd_model) + (count(*) OVER (PARTITION BY year, lgd_model) - 1) / 2e0 AS rb
          FROM t_years) GROUP BY year""",
)
_RANKS = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"
twin(
    "spearman_correlation",
    _P_SELECT,
    **_P_VALUE,
    t_correlation=f"""SELECT count(*) AS n, corr(ra, rb) AS r FROM (
      SELECT {_RANKS.format(c="lgd_pred")} AS ra, {_RANKS.format(c="lgd_model")} AS rb FROM t_severity)""",
)


def matrix_sql(columns) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS observations, round(corr(ra, rb), 6) AS spearman
        FROM (SELECT {_RANKS.format(c=a)} AS ra, {_RANKS.format(c=b)} AS rb FROM t_attached
              WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


_before = ["eltv", "current_actual_upb", "loan_age", "current_interest_rate"]
_static = ["ltv", "cltv", "credit_score", "dti", "interest_rate"]
twin(
    "spearman_matrix",
    matrix_sql(CORRELATION_COLUMNS),
    t_attached=f"""SELECT {", ".join(f"b.{c}" for c in _before)}, {", ".join(f"{cleaned(f'o.{c}', 'lgd', c)} AS {c}" for c in _static)},
        least(greatest(t.loss / t.ead, 0), 1) AS lgd_model
      FROM (SELECT DISTINCT loan_identifier, default_month, record_id, {", ".join(f"{cleaned(c, 'lgd')} AS {c}" for c in _before)}
            FROM t_history WHERE observation_type = '1_month_before' AND default_month <= {CORRELATION_LAST_MONTH}) b
      JOIN t_targets t ON b.loan_identifier = t.loan_identifier AND b.default_month = t.default_month
      JOIN v_orig o ON b.loan_identifier = o.loan_identifier""",
)
_pairs = ["eltv", "ltv", "current_actual_upb", "loan_age", "credit_score", "current_interest_rate"]
twin(
    "spearman_matrix_performance",
    matrix_sql(_pairs),
    t_attached=f"""SELECT {", ".join(f"{cleaned(c, 'lgd')} AS {c}" for c in _pairs)}
        FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier""",
)

# ---- classification ----

for _name, _p in (("classification_metrics", "pd_12m"), ("classification_metrics_tied", "p_tie")):
    twin(_name, f"SELECT {select_metrics()} FROM t_groups", t_groups=score_table("v_scored", _p))
twin(
    "monthly_performance",
    f"SELECT observation_month, {select_metrics(MONTHLY)} FROM t_groups GROUP BY 1",
    t_groups=score_table("v_scored", "pd_12m", "observation_month"),
)
twin(
    "monthly_performance_all_events",
    f"SELECT observation_month, {select_metrics(MONTHLY)} FROM t_groups GROUP BY 1",
    t_copies=f"SELECT observation_month, default_12m, {proxy.FORMULA_PD} FROM t_panel_all",
    t_groups=score_table("t_copies", "pd_12m_cal", "observation_month"),
)
_TOTALS = "(SELECT sum(default_12m) AS p_all, count(*) - sum(default_12m) AS n_all FROM v_scored)"
twin(
    "roc_points",
    f"""SELECT round(fp / n_all, 9) AS fpr, round(tp / p_all, 9) AS tpr, round(p, 9) AS threshold FROM (
      SELECT *, lag(p) OVER w AS best, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
      FROM t_groups WINDOW w AS (ORDER BY p DESC)), {_TOTALS}
    WHERE best IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT 0e0, 0e0, CAST('inf' AS DOUBLE)""",
    t_groups=score_table("v_scored", "pd_12m"),
)
twin(
    "roc_points_tied",
    f"""SELECT round(fp / n_all, 9) AS fpr, round(tp / p_all, 9) AS tpr, round(p, 9) AS threshold FROM t_groups, {_TOTALS}
    UNION ALL SELECT 0e0, 0e0, CAST('inf' AS DOUBLE)""",
    t_groups=score_table("v_scored", "p_tie"),
)
twin(
    "pr_points",
    f"""SELECT round(tp / p_all, 9) AS recall, round(tp / (tp + fp), 9) AS precision, round(p, 9) AS threshold,
      round(p_all / (p_all + n_all), 9) AS baseline FROM t_groups, {_TOTALS}
    UNION ALL SELECT 0e0, 1e0, NULL, round(p_all / (p_all + n_all), 9) FROM {_TOTALS}""",
    t_groups=score_table("v_scored", "pd_12m"),
)
for _name, _p in (("capture_lift", "pd_12m"), ("capture_lift_tied", "p_tie")):
    twin(
        _name,
        """SELECT CAST(pct AS INT) AS top_percent, CAST(any_value(size) AS BIGINT) AS observations,
          CAST(sum(default_12m) AS BIGINT) AS defaults_captured, CAST(any_value(p_all) AS BIGINT) AS total_defaults,
          round(sum(default_12m) / any_value(p_all), 6) AS capture_rate,
          round(avg(default_12m) / any_value(p_all / (p_all + n_all)), 6) AS lift
        FROM t_ranked, (SELECT pct, p_all, n_all, (p_all + n_all) * pct // 100 AS size
                        FROM unnest([1, 5, 10, 20, 30, 50]) u(pct), """
        + _TOTALS
        + """) WHERE rn <= size GROUP BY pct""",
        t_ranked=f"""SELECT default_12m, row_number() OVER (ORDER BY {_p} DESC,
          md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber))) AS rn FROM v_scored""",
    )
for _name, _p in (("calibration_table", "pd_12m"), ("calibration_table_tied", "p_tie")):
    twin(
        _name,
        f"""SELECT CAST({bin_sql(_p, "edges")} AS INT) AS risk_group, count(*) AS observations,
          round(avg({_p}), 8) AS avg_predicted_probability, round(avg(default_12m), 8) AS actual_default_rate,
          CAST(sum(default_12m) AS BIGINT) AS defaults
        FROM v_scored, t_edges GROUP BY 1""",
        t_edges=edges_sql("v_scored", _p, 10),
    )

# Newton's method on the penalised logistic fit, as a recursive table of (step, intercept, slope)
_CAL = {
    "t_logits": """
        SELECT ln(q / (1 - q)) AS x, sum(default_12m) AS pos, count(*) AS n
        FROM (SELECT least(greatest(pd_12m, 1e-15), 1 - 1e-15) AS q, default_12m FROM v_scored
              WHERE observation_month BETWEEN 199901 AND 199912) GROUP BY 1""",
    "t_newton": """
        SELECT 0 AS k, 0e0 AS a, 1e0 AS b
        UNION ALL SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
          b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        FROM (SELECT k, a, b, sum(r) AS g0, sum(r * x) - b / 1e6 AS g1, sum(w) AS h00, sum(w * x) AS h01,
                sum(w * x * x) + 1 / 1e6 AS h11
              FROM (SELECT k, a, b, x, pos - n / (1 + exp(-(a + b * x))) AS r,
                      n / (1 + exp(-(a + b * x))) * (1 - 1 / (1 + exp(-(a + b * x)))) AS w
                    FROM t_newton, t_logits WHERE k < 25)
              GROUP BY k, a, b)""",
    "t_calibrated": """
        SELECT *, 1 / (1 + exp(-(a + b * ln(q / (1 - q))))) AS pd_12m_cal
        FROM (SELECT *, least(greatest(pd_12m, 1e-15), 1 - 1e-15) AS q FROM v_scored
              WHERE observation_month BETWEEN 200001 AND 200112), (SELECT a, b FROM t_newton WHERE k = 25)""",
}
twin("calibrated_scores", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(pd_12m_cal, 9) AS pd_12m_cal FROM t_calibrated", **_CAL)
twin(
    "calibrated_metrics",
    f"""SELECT 'raw' AS model, {select_metrics()} FROM t_raw
    UNION ALL SELECT 'calibrated', {select_metrics()} FROM t_after""",
    **_CAL,
    t_raw=score_table("t_calibrated", "pd_12m"),
    t_after=score_table("t_calibrated", "pd_12m_cal"),
)
twin(
    "monthly_calibration",
    """SELECT observation_month, CAST(sum(default_12m) AS BIGINT) AS defaults, count(*) AS observations,
      round(avg(pd_12m), 8) AS avg_predicted_probability, round(avg(pd_12m_cal), 8) AS avg_predicted_probability_cal,
      round(avg(default_12m), 8) AS actual_default_rate FROM t_calibrated GROUP BY 1""",
    **_CAL,
)
twin(
    "log_odds_round_trip",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(z, 9) AS z, round(1 / (1 + exp(-z)), 9) AS p FROM (
      SELECT *, ln(pd_12m / (1 - pd_12m)) AS z FROM v_scored)""",
)
twin(
    "score_summary",
    """SELECT count(pd_12m) AS observations, round(sum(pd_12m), 4) AS total, round(avg(pd_12m), 6) AS mean,
      round(min(pd_12m), 6) AS minimum, round(max(pd_12m), 6) AS maximum FROM v_scored""",
)

# ---- drift, samples, preparation ----


def psi_sql(features, table: str, train: str, test: str) -> tuple[str, dict[str, str]]:
    parts, rows = {}, []
    for i, f in enumerate(features):
        parts[f"t_edges_{i}_"] = edges_sql(f"{table}_train", f, 10)
        rows.append(
            f"""SELECT '{f}' AS feature, side, CASE WHEN {f} IS NULL THEN -1 ELSE {bin_sql(f, "edges")} END AS bin
            FROM {table}_both, t_edges_{i}_"""
        )
    parts[f"{table}_both"] = f"""
        SELECT 0 AS side, * FROM {table} WHERE {train} UNION ALL SELECT 1 AS side, * FROM {table} WHERE {test}"""
    parts[f"{table}_train"] = f"SELECT * FROM {table} WHERE {train}"
    parts["t_bins"] = "\nUNION ALL\n".join(rows)
    body = """SELECT feature, round(sum((a - e) * ln(a / e)), 8) AS psi FROM (
      SELECT feature, greatest(rn / sum(rn) OVER (PARTITION BY feature), 1e-6) AS e,
        greatest(an / sum(an) OVER (PARTITION BY feature), 1e-6) AS a
      FROM (SELECT feature, bin, count(*) FILTER (side = 0) AS rn, count(*) FILTER (side = 1) AS an
            FROM t_bins GROUP BY 1, 2))
    GROUP BY 1"""
    return body, parts


_body, _parts = psi_sql(
    DRIFT_FEATURES, "t_features", "observation_month <= 199812", "observation_month BETWEEN 200001 AND 200112"
)
twin(
    "psi_table",
    _body,
    t_features=f"""SELECT monthly_reporting_period AS observation_month,
        {", ".join("o.upb AS original_upb" if c == "original_upb" else
                   f"({STATUS}) AS {c}" if c == "delinquency_status_numeric" else f"{cleaned(c, 'score')} AS {c}"
                   for c in DRIFT_FEATURES)}
        FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier""",
    **_parts,
)
_body, _parts = psi_sql(
    ["pd_12m", "p_tie"], "t_scores", "observation_month <= 199812", "observation_month BETWEEN 200001 AND 200112"
)
twin("psi_scores", _body, t_scores="SELECT observation_month, pd_12m, p_tie FROM v_scored", **_parts)
twin(
    "temporal_split_counts",
    f"""SELECT {split_of("observation_month")} AS split, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS defaults
    FROM v_scored GROUP BY 1""",
)
twin(
    "union_validation_test",
    f"SELECT observation_month, {select_metrics(MONTHLY)} FROM t_groups GROUP BY 1",
    t_both="""SELECT * FROM v_scored WHERE observation_month BETWEEN 199901 AND 199912
        UNION ALL SELECT * FROM v_scored WHERE observation_month BETWEEN 200001 AND 200112""",
    t_groups=score_table("t_both", "p_tie", "observation_month"),
)


def sample_sql(columns: str, size: str, where: str = "true") -> str:
    """An exact stratified sample of `size` rows, or of all rows if there are fewer."""
    return f"""SELECT {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY default_12m ORDER BY md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber))) AS rn
      FROM v_scored WHERE {where})
    JOIN (SELECT default_12m, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, n DESC) <= size - sum(base)
            OVER () THEN 1 ELSE 0 END AS quota
          FROM (SELECT default_12m, n, size, size * n // total AS base, size * n % total AS remainder
                FROM (SELECT default_12m, count(*) AS n FROM v_scored WHERE {where} GROUP BY 1),
                     (SELECT count(*) AS total, least(count(*), {size}) AS size FROM v_scored WHERE {where})))
      USING (default_12m) WHERE rn <= quota"""


# the weighted queries count a row `copies` times; their twins see the rows themselves
_COPIES = {
    "t_copies": f"""SELECT record_id, observation_month, default_12m, {proxy.FORMULA_PD}, original_upb FROM t_panel_all""",
}
_COPY_TOTALS = "(SELECT sum(default_12m) AS p_all, count(*) - sum(default_12m) AS n_all FROM t_copies)"
twin(
    "calibration_table_all_events",
    f"""SELECT CAST({bin_sql("pd_12m_cal", "edges")} AS INT) AS risk_group, count(*) AS observations,
      round(avg(pd_12m_cal), 8) AS avg_predicted_probability, round(avg(default_12m), 8) AS actual_default_rate,
      CAST(sum(default_12m) AS BIGINT) AS defaults
    FROM t_copies, t_edges GROUP BY 1""",
    **_COPIES,
    t_edges=edges_sql("t_copies", "pd_12m_cal", 10),
)
twin(
    "capture_lift_all_events",
    f"""SELECT CAST(pct AS INT) AS top_percent, CAST(any_value(size) AS BIGINT) AS observations,
      CAST(sum(default_12m) AS BIGINT) AS defaults_captured, CAST(any_value(p_all) AS BIGINT) AS total_defaults,
      round(sum(default_12m) / any_value(p_all), 6) AS capture_rate,
      round(avg(default_12m) / any_value(p_all / (p_all + n_all)), 6) AS lift
    FROM (SELECT default_12m, row_number() OVER (ORDER BY pd_12m_cal DESC, md5(concat_ws(':', '42', record_id, default_12m))) AS rn
          FROM t_copies),
         (SELECT pct, p_all, n_all, (p_all + n_all) * pct // 100 AS size FROM unnest([1, 5, 10, 20, 30, 50]) u(pct), {_COPY_TOTALS})
    WHERE rn <= size GROUP BY pct""",
    **_COPIES,
)
twin(
    "roc_points_all_events",
    f"""SELECT round(fp / n_all, 9) AS fpr, round(tp / p_all, 9) AS tpr, round(p, 9) AS threshold FROM (
      SELECT *, lag(p) OVER w AS best, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
      FROM t_groups WINDOW w AS (ORDER BY p DESC)), {_COPY_TOTALS}
    WHERE best IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT 0e0, 0e0, CAST('inf' AS DOUBLE)""",
    **_COPIES,
    t_groups=score_table("t_copies", "pd_12m_cal"),
)
twin(
    "calibrator_all_events",
    "SELECT round(a, 6) AS alpha, round(b, 6) AS beta FROM t_newton WHERE k = 25",
    **_COPIES,
    # from a start near the optimum: plain steps do not converge from (0, 1) on these scores
    t_newton=_CAL["t_newton"].replace("0e0 AS a, 1e0 AS b", "-2e0 AS a, 0e0 AS b"),
    t_logits="""
        SELECT ln(q / (1 - q)) AS x, sum(default_12m) AS pos, count(*) AS n
        FROM (SELECT least(greatest(pd_12m_cal, 1e-15), 1 - 1e-15) AS q, default_12m FROM t_copies) GROUP BY 1""",
)
_body, _parts = psi_sql(
    ["pd_12m_cal", "original_upb"], "t_copies", "observation_month <= 199712",
    "observation_month BETWEEN 199801 AND 200112",
)
twin("psi_all_events", _body, **_COPIES, **_parts)
twin(
    "stratified_sample_all_events",
    """SELECT record_id, default_12m, CAST(count(*) AS BIGINT) AS copies FROM (
      SELECT *, row_number() OVER (PARTITION BY default_12m ORDER BY md5(concat_ws(':', '42', record_id))) AS rn FROM t_copies)
    JOIN (SELECT default_12m, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, n DESC) <= size - sum(base)
            OVER () THEN 1 ELSE 0 END AS quota
          FROM (SELECT default_12m, n, size, size * n // total AS base, size * n % total AS remainder
                FROM (SELECT default_12m, count(*) AS n FROM t_copies GROUP BY 1),
                     (SELECT count(*) AS total, CAST(floor(count(*) * 0.3e0) AS BIGINT) AS size FROM t_copies)))
      USING (default_12m) WHERE rn <= quota GROUP BY 1, 2""",
    **_COPIES,
)
_SAMPLED = "l_orderkey, l_partkey, l_suppkey, l_linenumber, observation_month, default_12m"
twin("stratified_sample", sample_sql(_SAMPLED, "CAST(floor(count(*) * 0.4e0) AS BIGINT)"))
twin("stratified_sample_exact", sample_sql(_SAMPLED, "20000"))
_SAMPLED = "l_orderkey, l_partkey, l_suppkey, l_linenumber, default_12m"
twin(
    "training_sample",
    sample_sql(f"{_SAMPLED}, 'train' AS split", str(TRAIN_ROWS), "observation_month <= 199812")
    + "\nUNION ALL\n"
    + sample_sql(f"{_SAMPLED}, 'validation' AS split", str(VALIDATION_ROWS), "observation_month BETWEEN 199901 AND 199912"),
)
twin(
    "feature_vectors",
    "\nUNION ALL\n".join(
        [
            f"""SELECT loan_identifier, observation_month, record_id, '{c}' AS slot,
              round(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM t_train)), 6) AS value FROM t_rows
            WHERE coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM t_train)) <> 0"""
            for c in PD_NUMERIC
        ]
        + [
            f"""SELECT loan_identifier, observation_month, record_id, '{c}=' || level AS slot, 1e0 AS value
            FROM (SELECT *, coalesce({c}, (SELECT {c} FROM t_train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
                    AS level FROM t_rows)
            WHERE level IN (SELECT {c} FROM t_train)"""
            for c in PD_CATEGORICAL
        ]
    ),
    t_rows=f"""SELECT loan_identifier, observation_month, record_id, {_model_columns([*PD_NUMERIC, *PD_CATEGORICAL], "unified")}
        FROM t_panel""",
    t_train="SELECT * FROM t_rows WHERE observation_month <= 199812",
)
_num, _cat = PD_NUMERIC, PD_CATEGORICAL
twin(
    "impute_scale",
    f"""SELECT loan_identifier, observation_month,
      {", ".join(f"round(({c} - (SELECT avg({c}) FROM t_filled)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM t_filled), 6) AS {c}" for c in _num)},
      {", ".join(_cat)} FROM t_filled""",
    t_cleaned=f"SELECT loan_identifier, observation_month, {_model_columns([*_num, *_cat], 'score')} FROM t_panel",
    t_filled=f"""SELECT loan_identifier, observation_month,
      {", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM t_cleaned)) AS {c}" for c in _num)},
      {", ".join(
          f"coalesce({c}, (SELECT {c} FROM t_cleaned WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}"
          for c in _cat)} FROM t_cleaned""",
)

# the penalised score equations of a logistic fit are 0 at its optimum
twin(
    "pd_model_lr_equations",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS slot, 0e0 AS equation" for c in PD_NUMERIC]
        + [
            f"""SELECT DISTINCT '{c}=' || coalesce({c}, (SELECT {c} FROM t_train WHERE {c} IS NOT NULL GROUP BY 1
              ORDER BY count(*) DESC, 1 LIMIT 1)), 0e0 FROM t_train"""
            for c in PD_CATEGORICAL
        ]
        + [f"SELECT '{c}=(unknown)', 0e0" for c in PD_CATEGORICAL]
    ),
    t_train=f"""SELECT {_model_columns([*PD_NUMERIC, *PD_CATEGORICAL], "unified")} FROM t_panel
        WHERE observation_month <= 199812""",
)
twin(
    "model_periods",
    f"""SELECT {split_of("observation_month")} AS split, min(observation_month) AS first_month,
      max(observation_month) AS last_month, count(*) AS n, CAST(sum(default_12m) AS BIGINT) AS defaults
    FROM t_panel GROUP BY 1""",
)

# ---- expected loss ----

twin(
    "stage_assignment",
    f"""SELECT record_id, {BUCKET} AS delinquency_bucket,
      CASE WHEN zero_balance_code IN (2, 3, 9) THEN 3 WHEN ({BUCKET}) IN {LATE} THEN 2 ELSE 1 END AS stage
    FROM v_perf WHERE zero_balance_code IS DISTINCT FROM 1""",
)
twin(
    "pd_term_structure",
    f"""SELECT CAST(t AS INT) AS t, count(*) AS n, round(avg(h * pow(1 - h, t - 1)), 9) AS marginal_pd,
      round(avg(1 - pow(1 - h, t)), 9) AS cumulative_pd,
      round(avg(1 / pow(1 + current_interest_rate / 100, t / 12e0)), 9) AS discount_factor
    FROM (SELECT *, 1 - pow(1 - pd_12m_cal, 1e0 / 12) AS h, unnest(range(1, months_to_legal_maturity + 1)) AS t
          FROM (SELECT months_to_legal_maturity, current_interest_rate, {proxy.FORMULA_PD} FROM v_perf)) GROUP BY 1""",
)
twin("last_balance", "SELECT * FROM t_last")
twin(
    "last_balance_snapshot",
    f"""SELECT loan_identifier, monthly_reporting_period AS observation_month, record_id, last_upb FROM (
      SELECT *, lag(current_actual_upb) OVER (PARTITION BY loan_identifier ORDER BY monthly_reporting_period, record_id)
        AS last_upb FROM v_perf WHERE monthly_reporting_period BETWEEN {SNAPSHOT - 1} AND {SNAPSHOT})
    WHERE zero_balance_code IN (2, 3, 9) AND current_actual_upb = 0 AND last_upb IS NOT NULL""",
)
twin(
    "balance_lookup",
    """SELECT p.loan_identifier, p.monthly_reporting_period AS observation_month, p.record_id, b.last_upb
    FROM v_perf p LEFT JOIN (SELECT loan_identifier, observation_month, arg_max(last_upb, record_id) AS last_upb FROM t_last GROUP BY 1, 2) b
      ON p.loan_identifier = b.loan_identifier AND p.monthly_reporting_period = b.observation_month""",
)
twin(
    "combine_scores",
    f"""SELECT loan_identifier, monthly_reporting_period AS observation_month, record_id, {proxy.FORMULA_PD},
      {proxy.FORMULA_LGD} FROM v_perf""",
)
_ECL = """loan_identifier, observation_month, record_id, months_to_legal_maturity, stage, round(lgd, 9) AS lgd,
      round(ead, 2) AS ead, round(hazard_factor, 9) AS hazard_factor, round(ecl, 2) AS ecl"""
twin("ecl_portfolio", f"SELECT {_ECL} FROM t_ecl")
twin("ecl_snapshot", f"SELECT {_ECL} FROM t_ecl WHERE observation_month = {SNAPSHOT}")
_DECILES = {
    "t_edges": edges_sql("t_ecl", "pd_12m_cal", 10),
    "t_deciles": f"SELECT *, CAST({bin_sql('pd_12m_cal', 'edges')} AS INT) + 1 AS pd_decile FROM t_ecl, t_edges",
}
twin(
    "decile_profile",
    """SELECT pd_decile, round(avg(pd_12m_cal), 6) AS mean_pd, round(avg(credit_score), 6) AS mean_credit_score,
      round(avg(dti), 6) AS mean_dti, round(avg(ltv), 6) AS mean_ltv, round(avg(eltv), 6) AS mean_eltv,
      round(avg(loan_age), 6) AS mean_loan_age, round(avg(ead), 2) AS mean_ead FROM t_deciles GROUP BY 1""",
    **_DECILES,
)
twin(
    "decile_ecl",
    """SELECT pd_decile, count(*) AS loans, round(avg(pd_12m_cal), 6) AS mean_pd, round(avg(lgd), 6) AS mean_lgd,
      round(avg(ead), 2) AS mean_ead, round(avg(ecl), 2) AS mean_ecl, round(sum(ecl), 2) AS total_ecl,
      round(sum(ecl) / (SELECT sum(ecl) FROM t_ecl), 6) AS ecl_share, round(avg(stage), 6) AS stage_mean
    FROM t_deciles GROUP BY 1""",
    **_DECILES,
)
twin(
    "stage_ecl",
    """SELECT stage, count(*) AS loans, round(coalesce(sum(ead), 0), 2) AS total_ead,
      round(coalesce(sum(ecl), 0), 2) AS total_ecl, round(avg(ecl), 2) AS mean_ecl, round(avg(pd_12m_cal), 6) AS mean_pd
    FROM t_deciles WHERE pd_decile = 10 GROUP BY 1""",
    **_DECILES,
)
for _name in ("pd_panel_first", "last_balance"):
    ORACLES[f"{_name.removesuffix('_first')}_bucketed"] = ORACLES[_name]
for _name in ("stored_performance", "stored_stage"):
    ORACLES[_name] = ORACLES["month_range"]
twin(
    "stored_csv",
    f"""SELECT loan_identifier, monthly_reporting_period, record_id, round(pd_12m_cal, 9) AS pd_12m_cal FROM (
      SELECT loan_identifier, monthly_reporting_period, record_id, {proxy.FORMULA_PD} FROM v_perf)""",
)
twin(
    "declared_tables",
    """SELECT monthly_reporting_period, count(*) AS n, CAST(sum(o.credit_score) AS BIGINT) AS credit_score,
      round(CAST(sum(p.current_actual_upb) AS DOUBLE), 2) AS current_actual_upb
    FROM v_perf p JOIN v_orig o ON p.loan_identifier = o.loan_identifier WHERE monthly_reporting_period = 199803 GROUP BY 1""",
)
twin(
    "saved_models",
    f"""SELECT model, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM t_panel, unnest(['lr', 'gbt', 'rf']) u(model)
    WHERE {split_of("observation_month")} IN ('validation', 'test') GROUP BY model""",
)
