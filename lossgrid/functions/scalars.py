"""Column expressions of the loss model. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lossgrid.fixed import DEFAULT_CODES, LATE_BUCKETS, PROBABILITY_FLOOR


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a number on one or both sides; missing values (NULL and NaN) stay missing instead of turning into a bound."""
    c = as_col(c)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        # NaN is larger than every number in Spark
        out = F.when((c > high) & ~F.isnan(c.cast("double")), F.lit(high)).otherwise(out)
    return out


def parse_numeric_status(c: Column | str) -> Column:
    """Digits-only text as integer; every other code is NULL (the pattern also refuses padded or signed digits)."""
    c = as_col(c)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def realised_ratio(loss: Column | str, exposure: Column | str) -> Column:
    """loss / exposure with the floating-point limits kept: a loss on no exposure is infinite, nothing on nothing is missing."""
    loss, exposure = as_col(loss), as_col(exposure)
    on_zero = F.when(loss > 0, F.lit(float("inf"))).when(loss < 0, F.lit(float("-inf")))
    return F.when(exposure == 0, on_zero).otherwise(F.try_divide(loss, exposure))


def delinquency_bucket(c: Column | str) -> Column:
    """Months behind (as text) to the reporting bucket; codes that are no number have no bucket."""
    months = parse_numeric_status(c)
    return (
        F.when(months == 0, "current")
        .when(months == 1, "30-59")
        .when(months == 2, "60-89")
        .when(months == 3, "90-119")
        .when(months >= 4, "120+")
    )


def is_in(c: Column | str, values) -> Column:
    """Membership test that says False (not NULL) for a missing value."""
    return F.coalesce(as_col(c).isin(*values), F.lit(False))


def is_not(c: Column | str, value) -> Column:
    """Inequality that keeps missing values."""
    return ~as_col(c).eqNullSafe(F.lit(value))


def assign_stage(code: Column | str, status: Column | str) -> Column:
    """3 for a default code, else 2 for a late bucket, else 1."""
    return (
        F.when(is_in(code, DEFAULT_CODES), 3)
        .when(is_in(delinquency_bucket(status), LATE_BUCKETS), 2)
        .otherwise(1)
    )


def log_odds(p: Column | str, floor: float = PROBABILITY_FLOOR) -> Column:
    p = clip(as_col(p).cast("double"), floor, 1 - floor)
    return F.ln(p / (1 - p))


def from_log_odds(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-as_col(z)))


def hazard(pd_12m: Column | str) -> Column:
    """Constant monthly default intensity with the given 12-month probability."""
    return 1 - F.pow(1 - as_col(pd_12m), F.lit(1.0 / 12.0))


def marginal_pd(h: Column | str, month: Column | str) -> Column:
    h = as_col(h)
    return h * F.pow(1 - h, as_col(month) - 1)


def cumulative_pd(h: Column | str, month: Column | str) -> Column:
    return 1 - F.pow(1 - as_col(h), as_col(month))


def discount_factor(rate_percent: Column | str, months: Column | str | int, basis: str = "effective_annual") -> Column:
    """Present value of 1 paid in `months` months; `nominal_monthly` compounds a twelfth of the rate each month."""
    rate = as_col(rate_percent).cast("double")
    months = F.lit(months) if isinstance(months, int) else as_col(months)
    if basis == "effective_annual":
        return F.pow(1 + rate / 100, -months / 12)
    if basis == "nominal_monthly":
        return F.pow(1 + rate / 1200, -months)
    raise ValueError(f"unknown discount basis: {basis}")


def ecl_12m(pd_12m: Column | str, lgd: Column | str, ead: Column | str) -> Column:
    return as_col(pd_12m) * as_col(lgd) * as_col(ead)


def ecl_lifetime(
    pd_12m: Column | str,
    lgd: Column | str,
    ead: Column | str,
    rate_percent: Column | str,
    months: Column | str,
    basis: str = "effective_annual",
) -> Column:
    """Discounted loss over all remaining months as a geometric series, so no row is expanded into its months."""
    h = hazard(pd_12m)
    v = discount_factor(rate_percent, 1, basis)
    months = as_col(months)
    ratio = (1 - h) * v
    series = F.when(ratio == 1, months.cast("double")).otherwise(F.try_divide(1 - F.pow(ratio, months), 1 - ratio))
    return as_col(lgd) * as_col(ead) * h * v * series


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
