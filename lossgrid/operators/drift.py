"""Population stability of features between two samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.fixed import DRIFT_FEATURES, PSI_BINS, PSI_SHARE_FLOOR
from lossgrid.functions.scalars import nan_to_null
from lossgrid.operators.binning import bin_number, quantile_edges
from lossgrid.operators.order import row_weight


def psi_bins(
    reference: DataFrame,
    actual: DataFrame,
    features: Sequence[str] = DRIFT_FEATURES,
    bins: int = PSI_BINS,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Row counts and shares per feature and bin; -1 is the bin of missing values.

    Bins are quantiles of the reference sample with open outer ends. Both samples are binned by column expressions and
    counted in one aggregation that combines map-side, so the shuffle carries features * bins rows per task. With
    `weight`, a column of both samples, a row counts that many times.
    """
    features = list(features)
    edges = quantile_edges(reference, features, bins, rows_per_bucket, weight)

    def cells(df: DataFrame, side: int) -> DataFrame:
        clean = df.select(*[nan_to_null(f).alias(f) for f in features], row_weight(weight).alias("_w"))
        structs = [
            F.struct(F.lit(f).alias("feature"), F.coalesce(bin_number(f, edges[f]), F.lit(-1)).alias("bin"))
            for f in features
        ]
        return clean.select(F.inline(F.array(*structs)), "_w", F.lit(side).alias("side")).where(F.col("_w") > 0)

    counts = (
        cells(reference, 0)
        .unionByName(cells(actual, 1))
        .groupBy("feature", "bin")
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("_w")).otherwise(0)).alias("reference_rows"),
            F.sum(F.when(F.col("side") == 1, F.col("_w")).otherwise(0)).alias("actual_rows"),
        )
    )
    # at most bins + 1 rows per feature
    feature = Window.partitionBy("feature")

    def share(column: str):
        part = F.try_divide(F.col(column).cast("double"), F.sum(column).over(feature))
        return F.when(part > PSI_SHARE_FLOOR, part).otherwise(PSI_SHARE_FLOOR)

    return counts.select(
        "*", share("reference_rows").alias("reference_share"), share("actual_rows").alias("actual_share")
    )


def psi(
    reference: DataFrame,
    actual: DataFrame,
    features: Sequence[str] = DRIFT_FEATURES,
    bins: int = PSI_BINS,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Population stability index per feature, most drifted first."""
    a, e = F.col("actual_share"), F.col("reference_share")
    return (
        psi_bins(reference, actual, features, bins, rows_per_bucket, weight)
        .groupBy("feature")
        .agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
        .orderBy(F.desc("psi"), "feature")
    )
