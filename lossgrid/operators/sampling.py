"""Temporal splits and exact stratified samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgrid.fixed import SEED
from lossgrid.functions.months import ym_year
from lossgrid.operators.binning import sample_order, take_first
from lossgrid.operators.order import row_weight

PD_SPLIT = {"train": (None, 2023), "validation": (2024, 2024), "test": (2025, 2025)}
PD_REESTIMATION_SPLIT = {"train": (None, 2024), "test": (2025, 2025)}
LGD_SPLIT = {"train": (None, 2021), "validation": (2022, 2023), "test": (2024, 2025)}


def check_disjoint(bounds: Mapping[str, tuple[int | None, int | None]]) -> None:
    """Raise if a year belongs to two parts."""
    spans = sorted((lo if lo is not None else -(10**6), hi if hi is not None else 10**6, name) for name, (lo, hi) in bounds.items())
    for (_, hi, a), (lo, _, b) in zip(spans, spans[1:]):
        if lo <= hi:
            raise ValueError(f"parts {a} and {b} share the year {lo}")


def temporal_split(
    df: DataFrame, month: str, bounds: Mapping[str, tuple[int | None, int | None]]
) -> dict[str, DataFrame]:
    """One filter per part on the integer month, so each part prunes partitions by itself."""
    check_disjoint(bounds)
    parts = {}
    for name, (lo, hi) in bounds.items():
        part = df
        if lo is not None:
            part = part.where(F.col(month) >= lo * 100 + 1)
        if hi is not None:
            part = part.where(F.col(month) <= hi * 100 + 12)
        parts[name] = part
    return parts


def with_split(df: DataFrame, month: str, bounds: Mapping[str, tuple[int | None, int | None]], out: str = "split") -> DataFrame:
    """The same split as a column; NULL outside all parts."""
    check_disjoint(bounds)
    year, c = ym_year(month), F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (year >= lo)
        if hi is not None:
            inside = inside & (year <= hi)
        c = F.when(inside, name).otherwise(c)
    return df.withColumn(out, c)


def stratum_quotas(counts: Mapping, size: int) -> dict:
    """Shares of `size` in proportion to the strata, rounded by largest remainder (larger stratum first on ties)."""
    total = sum(counts.values())
    if size >= total:
        return dict(counts)
    quotas = {s: size * n // total for s, n in counts.items()}
    by_remainder = sorted(counts, key=lambda s: (-(size * counts[s] % total), -counts[s], str(s)))
    for s in by_remainder[: size - sum(quotas.values())]:
        quotas[s] += 1
    return quotas


def stratum_sizes(df: DataFrame, stratum: str, weight: str | None = None) -> dict:
    """Rows per class label, without those that have none (an action; one number per class)."""
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.sum(row_weight(weight)).alias("n"))
    return {r[0]: r[1] for r in counts.collect() if r[1]}


def stratified_sample(
    df: DataFrame, stratum: str, size: int, key: Sequence[str], seed: int = SEED, weight: str | None = None
) -> DataFrame:
    """Exactly `size` rows with the class shares of `df`, chosen by a seeded hash of the row key.

    The same rows come out on every run and cluster size. The only collected values are one count per stratum (the
    stratum is a class label) and one boundary per stratum. With `weight` a row stands for that many rows: `size` counts
    these, and the column of the result tells how many of them are in the sample.
    """
    quotas = stratum_quotas(stratum_sizes(df, stratum, weight), size)
    return take_first(df, stratum, quotas, sample_order(key, seed), weight=weight)


def stratified_fraction(
    df: DataFrame, stratum: str, fraction: float, key: Sequence[str], seed: int = SEED, weight: str | None = None
) -> DataFrame:
    """The exact sample with its size given as a share of the rows."""
    counts = stratum_sizes(df, stratum, weight)
    quotas = stratum_quotas(counts, int(sum(counts.values()) * fraction))
    return take_first(df, stratum, quotas, sample_order(key, seed), weight=weight)
