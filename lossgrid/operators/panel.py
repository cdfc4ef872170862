"""Default events and the loan-month panel with its forward-looking label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.fixed import DEFAULT_CODES, HORIZON_MONTHS, LAST_OBSERVABLE_MONTH, PORTFOLIO_MONTH
from lossgrid.functions.months import ym_index
from lossgrid.operators.skew import salted_join

LOAN = "loan_identifier"
MONTH = "monthly_reporting_period"


def default_events(perf: DataFrame, codes: Sequence[int] = DEFAULT_CODES) -> DataFrame:
    """Performance rows that end in default; a pure filter and projection."""
    return perf.where(F.col("zero_balance_code").isin(*codes)).select(
        LOAN, F.col(MONTH).alias("default_date"), F.col("zero_balance_code").alias("default_code")
    )


def snapshot(perf: DataFrame, month: int = PORTFOLIO_MONTH) -> DataFrame:
    return perf.where(F.col(MONTH) == month)


def between_months(perf: DataFrame, first: int, last: int) -> DataFrame:
    return perf.where(F.col(MONTH).between(first, last))


def observable(perf: DataFrame, cutoff: int = LAST_OBSERVABLE_MONTH) -> DataFrame:
    """Months whose whole outcome window lies in the data; a plain integer bound, so it prunes partitions."""
    return perf.where(F.col(MONTH) <= cutoff)


def attach_origination(perf: DataFrame, orig: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Add the static loan attributes (one row per loan) to each performance row."""
    return salted_join(perf, orig, LOAN, "inner", hot)


def alive(month: Column | str, default_date: Column | str) -> Column:
    """Not defaulted yet, or never: the month lies strictly before the default."""
    m = F.col(month) if isinstance(month, str) else month
    d = F.col(default_date) if isinstance(default_date, str) else default_date
    return d.isNull() | (m < d)


def defaults_within(month: Column | str, default_date: Column | str, horizon: int = HORIZON_MONTHS) -> Column:
    """1 if the default comes after the month and at most `horizon` months later, else 0."""
    ahead = ym_index(default_date) - ym_index(month)
    return F.when((ahead > 0) & (ahead <= horizon), 1).otherwise(0)


def label_panel(
    perf: DataFrame,
    events: DataFrame,
    horizon: int = HORIZON_MONTHS,
    cutoff: int | None = LAST_OBSERVABLE_MONTH,
    policy: str = "first",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Performance rows still alive, with `observation_month` and `default_12m`.

    policy "first": a loan defaults once, in its earliest event; at most one output row per input row.
    policy "all": each event of a loan gives its own copy of the row. Copies differ in nothing but the label, so they
    come as one row per label with their number in `copies` instead of as rows * events pairs.
    """
    if cutoff is not None:
        perf = observable(perf, cutoff)
    if policy == "first":
        first = events.groupBy(LOAN).agg(F.min("default_date").alias("_default"))
        joined = salted_join(perf, first, LOAN, "left", hot)
        out = joined.where(alive(MONTH, "_default")).withColumn(
            "default_12m", defaults_within(MONTH, "_default", horizon)
        )
        return out.drop("_default").withColumnRenamed(MONTH, "observation_month")
    if policy != "all":
        raise ValueError(f"unknown event policy: {policy}")

    # one entry per calendar month with an event: a loan's array is bounded by the months of history, not by its rows
    monthly = events.groupBy(LOAN, "default_date").agg(F.count(F.lit(1)).alias("n"))
    calendar = monthly.groupBy(LOAN).agg(
        F.collect_list(
            F.struct(F.col("default_date").alias("ym"), ym_index("default_date").alias("at"), "n")
        ).alias("_events")
    )
    joined = salted_join(perf, calendar, LOAN, "left", hot).withColumn("_at", ym_index(MONTH))

    def events_where(test) -> Column:
        kept = F.filter("_events", lambda e: (e["at"] > F.col("_at")) & test(e["at"] - F.col("_at")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda total, e: total + e["n"])

    soon = F.coalesce(events_where(lambda ahead: ahead <= horizon), F.lit(0))
    later = F.coalesce(events_where(lambda ahead: ahead > horizon), F.lit(1))  # never defaulted: one row, label 0
    copies = F.array(
        F.struct(F.lit(1).alias("default_12m"), soon.cast("long").alias("copies")),
        F.struct(F.lit(0).alias("default_12m"), later.cast("long").alias("copies")),
    )
    out = joined.select("*", F.inline(copies)).where(F.col("copies") > 0)
    return out.drop("_events", "_at").withColumnRenamed(MONTH, "observation_month")


def pd_panel(
    perf: DataFrame,
    orig: DataFrame,
    horizon: int = HORIZON_MONTHS,
    cutoff: int | None = LAST_OBSERVABLE_MONTH,
    policy: str = "first",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Events, label and static attributes in one plan: the loan-month modelling panel."""
    labelled = label_panel(perf, default_events(perf), horizon, cutoff, policy, hot)
    return attach_origination(labelled, orig.withColumnRenamed("upb", "original_upb"), hot)


def target_drift(panel: DataFrame, month: str = "observation_month", label: str = "default_12m") -> DataFrame:
    """Rows, defaults and default rate per month."""
    y = F.col(label)
    n = F.col("copies") if "copies" in panel.columns else F.lit(1)
    return (
        panel.groupBy(month)
        .agg(F.sum(n).cast("long").alias("observations"), F.sum(y * n).cast("long").alias("defaults"))
        .withColumn("actual_default_rate", F.col("defaults") / F.col("observations"))
    )
