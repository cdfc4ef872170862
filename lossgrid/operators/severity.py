"""Realised loss severity: the default month joined to the month before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.fixed import (
    DEFAULT_CODES,
    SEVERITY_FEATURES,
    SEVERITY_FLAGS,
    SEVERITY_LOAN_ATTRIBUTES,
    SEVERITY_TARGETS,
)
from lossgrid.functions.months import ym_add
from lossgrid.functions.scalars import as_col, clip, realised_ratio
from lossgrid.operators.clean import clean_sentinels, fill_flags
from lossgrid.operators.panel import LOAN, MONTH
from lossgrid.operators.skew import salted_join

EVENT = [LOAN, "default_month"]
HISTORY = [c for c in SEVERITY_FEATURES if c != "observation_month"] + [*SEVERITY_TARGETS, "borrower_assistance_plan"]

def observation_tag(month: Column | str, default_month: Column | str) -> Column:
    """`default_month`, `1_month_before`, or NULL for any other month."""
    m, d = as_col(month), as_col(default_month)
    return F.when(m == d, "default_month").when(m == ym_add(d, -1), "1_month_before")


def severity_events(perf: DataFrame, codes: Sequence[int] = DEFAULT_CODES) -> DataFrame:
    """One row per loan and default month, with the number of performance rows that report it."""
    return (
        perf.where(F.col("zero_balance_code").isin(*codes))
        .groupBy(LOAN, F.col(MONTH).alias("default_month"))
        .agg(F.count(F.lit(1)).alias("event_records"))
    )


def severity_history(perf: DataFrame, offsets: Sequence[int] = (0, 1), codes: Sequence[int] = DEFAULT_CODES) -> DataFrame:
    """Performance rows of a default month and of the months `offsets` before it.

    The offsets are expanded on the (small) event side, which leaves an equi join on (loan, month): a loan's rows are
    never paired with all its events. Each row meets at most one event per offset; repeated reports of an event are
    counted in `event_records` instead of repeating the row.
    """
    perf = clean_sentinels(perf, "lgd")
    months = F.array(*[ym_add("default_month", -k) for k in offsets])
    wanted = severity_events(perf, codes).withColumn(MONTH, F.explode(months))
    joined = perf.select(LOAN, MONTH, *[c for c in HISTORY], *_extras(perf)).join(wanted, [LOAN, MONTH])
    return joined.select(
        LOAN,
        F.col(MONTH).alias("observation_month"),
        "default_month",
        "event_records",
        observation_tag(MONTH, "default_month").alias("observation_type"),
        *HISTORY,
        *_extras(perf),
    )


def _extras(perf: DataFrame) -> list[str]:
    return [c for c in ("record_id",) if c in perf.columns]


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `keys`, each once however often it occurs there."""
    return df.join(keys.select(*on), list(on), "left_semi")


def valid_severity(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["delinquent_accrued_interest", "actual_loss", "zero_balance_removal_upb"])


def severity_targets(history: DataFrame, duplicates: str = "sum") -> DataFrame:
    """Realised exposure and loss per default event.

    A loan-month is one row by contract. Where it was reported in parts, "sum" adds the parts up, so an event has one
    target and the join back to the features cannot multiply rows; "repeat" keeps every part as a target of its own, as
    the source workflow does, and counts equal ones in `parts`.
    """
    if duplicates not in ("sum", "repeat"):
        raise ValueError(f"unknown policy for duplicate targets: {duplicates}")
    parts = valid_severity(history.where(F.col("observation_type") == "default_month"))
    amounts = SEVERITY_TARGETS[2:]
    if duplicates == "sum":
        table = parts.groupBy(*EVENT).agg(
            F.min("zero_balance_code").alias("zero_balance_code"),
            F.max("zero_balance_effective_date").alias("zero_balance_effective_date"),
            *[F.sum(F.col(c).cast("double")).alias(c) for c in amounts],
        )
    else:
        # each event of the month brings its own copy of a row
        same = [*EVENT, "zero_balance_code", "zero_balance_effective_date", *amounts]
        table = parts.groupBy(*same).agg(F.sum("event_records").cast("long").alias("parts"))
    return table.withColumn("ead", F.col("delinquent_accrued_interest") + F.col("zero_balance_removal_upb")).withColumn(
        "lgd", realised_ratio("actual_loss", "ead")
    )


def severity_dataset(
    history: DataFrame,
    orig: DataFrame | None = None,
    hot: DataFrame | None = None,
    duplicates: str = "sum",
) -> DataFrame:
    """Features one month before default with realised exposure, loss severity and its model target in [0, 1].

    Events without a row in the month before have no features and drop out, as do events without a valid target. With
    duplicates="repeat" a feature row comes once per distinct target of its event, with `parts` as their number.
    """
    before = history.where(F.col("observation_type") == "1_month_before").select(*EVENT, *SEVERITY_FEATURES, *_extras(history))
    out = fill_flags(before.join(severity_targets(history, duplicates), EVENT), SEVERITY_FLAGS)
    if orig is not None:
        attributes = clean_sentinels(orig.select(LOAN, *SEVERITY_LOAN_ATTRIBUTES), "lgd")
        out = salted_join(out, attributes, LOAN, "inner", hot)
    return out.withColumn("lgd_model", clip("lgd", 0.0, 1.0))
