"""Model quality measures that never sort all rows in one place."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossgrid.fixed import PROBABILITY_FLOOR
from lossgrid.functions.scalars import all_of, clip, nan_to_null
from lossgrid.operators.order import (
    BUCKET,
    centred_ranks,
    fit_cuts,
    ordered_totals,
    row_weight,
    running_totals,
    spread,
    with_bucket,
)
from lossgrid.session import materialise


def score_groups(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per distinct score, best first: positives and negatives on it and ranked above it.

    `weight` is a whole number per row, such as the copies of a panel row.
    """
    rows = counted(df, weight)
    return running_totals(rows, score, class_sums(label, weight), by, descending=True, rows_per_bucket=rows_per_bucket)


def counted(df: DataFrame, weight: str | None) -> DataFrame:
    """The rows that count at all."""
    return df if weight is None else df.where(row_weight(weight) > 0)


def class_sums(label: str, weight: str | None = None) -> dict[str, Column]:
    """What a row adds to the positives and to the negatives."""
    y, n = F.col(label).cast("long"), row_weight(weight)
    return {"pos": y * n, "neg": (1 - y) * n}


def _total(whole: DataFrame, name: str) -> Column:
    """A grand total as a scalar subquery; 0 without rows."""
    return F.coalesce(whole.select(name).scalar(), F.lit(0))


def _area_terms() -> dict[str, Column]:
    # doubles: products of two row counts leave the range of a long
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = F.col("pos_before") + pos
    seen = tp + F.col("neg_before") + neg
    return {
        # every negative is beaten by the positives above it, and by half of those it ties with
        "auc_area": F.sum(neg * (F.col("pos_before") + pos / 2)),
        "ap_area": F.sum(pos * tp / seen),
    }


def classification_metrics(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """ROC-AUC, average precision, Brier score, log loss and score summary, over all rows or per group.

    One table of distinct scores feeds every measure. The two areas need both classes and are NULL otherwise.
    """
    return group_metrics(score_groups(df, score, label, by, rows_per_bucket, weight), score, by)


def mapped_metrics(
    df: DataFrame, score: str, label: str, maps: dict[str, Column | str], rows_per_bucket: int | None = None, weight: str | None = None
) -> dict[str, DataFrame]:
    """Metrics of the score and of functions of it, such as its calibration, from one table of distinct scores.

    The rows are collapsed to that table once. A function of the score is computed on the table and ordered anew there,
    so scores that it makes equal are tied as they would be among the rows.
    """
    table = materialise(score_groups(df, score, label, (), rows_per_bucket, weight).select(score, "pos", "neg"), "scores")
    out = {}
    for name, how in maps.items():
        value = F.col(how) if isinstance(how, str) else how
        sums = {"pos": F.col("pos"), "neg": F.col("neg")}
        mapped = table.select(value.alias("_mapped"), "pos", "neg")
        groups = running_totals(mapped, "_mapped", sums, descending=True, rows_per_bucket=rows_per_bucket)
        out[name] = group_metrics(groups, "_mapped")
    return out


def group_metrics(groups: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The measures of `classification_metrics` from its table of distinct scores with running totals."""
    p, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    n = pos + neg
    q = clip(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    table = groups.groupBy(*by).agg(
        F.sum(n).alias("observations"),
        F.sum(pos).alias("defaults"),
        F.sum(n * p).alias("_p"),
        F.min(p).alias("min_predicted"),
        F.max(p).alias("max_predicted"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("_brier"),
        F.sum(-(pos * F.ln(q) + neg * F.ln(1 - q))).alias("_log_loss"),
        *[e.alias(name) for name, e in _area_terms().items()],
    )
    rows, defaults = F.col("observations"), F.col("defaults")
    both = (defaults > 0) & (defaults < rows)
    return table.select(
        *by,
        "observations",
        "defaults",
        F.try_divide(defaults, rows).alias("actual_default_rate"),
        F.try_divide(F.col("_p"), rows).alias("avg_predicted_probability"),
        "min_predicted",
        "max_predicted",
        F.when(both, F.try_divide(F.col("auc_area"), defaults.cast("double") * (rows - defaults))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("ap_area"), defaults)).alias("pr_auc"),
        F.try_divide(F.col("_brier"), rows).alias("brier"),
        F.try_divide(F.col("_log_loss"), rows).alias("log_loss"),
    )


def monthly_performance(
    df: DataFrame,
    month: str,
    score: str,
    label: str,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Default count and rate, mean score and both areas per month."""
    columns = ["defaults", "observations", "avg_predicted_probability", "actual_default_rate", "roc_auc", "pr_auc"]
    return classification_metrics(df, score, label, [month], rows_per_bucket, weight).select(month, *columns).orderBy(month)


def roc_points(
    df: DataFrame,
    score: str,
    label: str,
    drop_collinear: bool = True,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(fpr, tpr, threshold) for each distinct score, starting at (0, 0) above the best one.

    With `drop_collinear`, a point between two steps in the same direction is left out, as it does not bend the curve.
    With `weight` a row counts that many times. The grand totals come from the shuffle that the points come from.
    """
    rows, sums = counted(df, weight), class_sums(label, weight)
    groups, whole = ordered_totals(rows, score, sums, descending=True, rows_per_bucket=rows_per_bucket, keep_bucket=True)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    points = groups.select(BUCKET, score, "pos", "neg", tp.alias("tp"), fp.alias("fp"))
    if drop_collinear:
        step = F.struct("pos", "neg")
        inside = Window.partitionBy(BUCKET).orderBy(F.desc(score))
        points = points.withColumn("_next", F.lead(step).over(inside))
        first = points.groupBy(BUCKET).agg(F.max_by(step, F.col(score)).alias("_first"))
        # one row per bucket
        below = first.select(BUCKET, F.lead("_first").over(Window.orderBy(F.desc(BUCKET))).alias("_below"))
        points = points.join(F.broadcast(below), BUCKET)
        nxt = F.coalesce(F.col("_next"), F.col("_below"))
        top = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bends = nxt.isNull() | (nxt["pos"] != F.col("pos")) | (nxt["neg"] != F.col("neg"))
        points = points.where(top | bends)
    start = df.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(math.inf).alias(score)
    )
    return (
        points.select("tp", "fp", score)
        .unionByName(start)
        .select(
            F.try_divide(F.col("fp").cast("double"), _total(whole, "neg")).alias("fpr"),
            F.try_divide(F.col("tp").cast("double"), _total(whole, "pos")).alias("tpr"),
            F.col(score).alias("threshold"),
        )
    )


def pr_points(
    df: DataFrame, score: str, label: str, rows_per_bucket: int | None = None, weight: str | None = None
) -> DataFrame:
    """(recall, precision, threshold, baseline) for each distinct score, ending at recall 0 without a threshold."""
    rows, sums = counted(df, weight), class_sums(label, weight)
    groups, whole = ordered_totals(rows, score, sums, descending=True, rows_per_bucket=rows_per_bucket)
    pos, neg = _total(whole, "pos"), _total(whole, "neg")
    tp = F.col("pos_before") + F.col("pos")
    points = groups.select(
        F.try_divide(tp.cast("double"), pos).alias("recall"),
        (tp / (tp + F.col("neg_before") + F.col("neg"))).alias("precision"),
        F.col(score).alias("threshold"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(end).withColumn("baseline", F.try_divide(pos.cast("double"), pos + neg))


def regression_metrics(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Means, RMSE and MAE over the rows where both values are known."""
    a, b = nan_to_null(predicted), nan_to_null(actual)
    diff = a - b
    return (
        df.where(diff.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.avg(a).alias("mean_predicted"),
            F.avg(b).alias("mean_actual"),
            F.sqrt(F.avg(diff * diff)).alias("rmse"),
            F.avg(F.abs(diff)).alias("mae"),
        )
    )


def _correlation() -> Column:
    """Covariance over the deviations; NULL for a constant column."""
    return F.try_divide(F.col("cov"), F.sqrt(F.col("va") * F.col("vb")))


def with_p_value(correlation: DataFrame) -> DataFrame:
    """The one row of observations and correlation with its two-sided p-value (an action; two numbers)."""
    n, r = correlation.select("observations", "correlation").first()
    r = None if r is None else max(-1.0, min(1.0, r))
    cells = [F.lit(n).cast("long").alias("observations"), F.lit(r).cast("double").alias("correlation")]
    return correlation.sparkSession.range(1).select(*cells, F.lit(two_sided_p_value(r, n)).cast("double").alias("p_value"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: observations, linear correlation and p-value of the rows where both values are known."""
    both = df.select(nan_to_null(a).alias("a"), nan_to_null(b).alias("b")).dropna()
    moments = both.agg(
        F.count("a").alias("observations"),
        F.var_pop("a").alias("va"),
        F.var_pop("b").alias("vb"),
        F.covar_pop("a", "b").alias("cov"),
    )
    return with_p_value(moments.select("observations", _correlation().alias("correlation")))


def spearman(df: DataFrame, a: str, b: str, rows_per_bucket: int | None = None) -> DataFrame:
    """One row: observations, correlation of average ranks and its p-value."""
    table = spearman_matrix(df, [a, b], rows_per_bucket)
    return with_p_value(table.select("observations", F.col("spearman").alias("correlation")))


def grouped_correlations(
    df: DataFrame, by: Sequence[str], a: str, b: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """Per group: rows where both values are known, linear and rank correlation, each with its two-sided p-value.

    Any number of groups in one pass: rows are folded to distinct pairs, whose values look up their mean ranks. A
    correlation is NULL where a value is constant, a p-value where there are fewer than three rows.
    """
    by = list(by)
    both = df.select(*by, (nan_to_null(a) + 0.0).alias("a"), (nan_to_null(b) + 0.0).alias("b"))
    both = both.dropna(subset=[*by, "a", "b"])
    pairs = materialise(both.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("w")), "pairs")

    def ranked(value: str) -> DataFrame:
        table = running_totals(pairs, value, {"n": F.col("w")}, by, rows_per_bucket=rows_per_bucket)
        return table.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"r{value}"))

    rows = pairs.join(ranked("a"), [*by, "a"]).join(ranked("b"), [*by, "b"])
    rows = materialise(rows.select(*by, "w", "a", "b", "ra", "rb"), "ranked-pairs")
    w = F.col("w")
    means = rows.groupBy(*by).agg(
        F.sum("w").alias("n"), *[(F.sum(F.col(c) * w) / F.sum("w")).alias(f"m{c}") for c in ("a", "b", "ra", "rb")]
    )
    off = {c: F.col(c) - F.col(f"m{c}") for c in ("a", "b", "ra", "rb")}
    sums = [F.sum(w * off[x] * off[y]).alias(f"{x}_{y}") for x, y in (("a", "a"), ("b", "b"), ("a", "b"), ("ra", "ra"), ("rb", "rb"), ("ra", "rb"))]
    table = rows.join(means, by).groupBy(*by).agg(F.first("n").alias("observations"), *sums)

    def correlation(x: str, y: str) -> Column:
        return F.try_divide(F.col(f"{x}_{y}"), F.sqrt(F.col(f"{x}_{x}")) * F.sqrt(F.col(f"{y}_{y}")))

    found = table.select(*by, "observations", correlation("a", "b").alias("pearson"), correlation("ra", "rb").alias("spearman"))

    def with_chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one row per group
            n = batch.column("observations").to_pylist()
            for kind in ("pearson", "spearman"):
                r = [None if x is None else max(-1.0, min(1.0, x)) for x in batch.column(kind).to_pylist()]
                chance = [two_sided_p_value(x, k) for x, k in zip(r, n, strict=True)]
                batch = batch.append_column(f"{kind}_p", pa.array(chance, pa.float64()))
            yield batch

    schema = StructType(list(found.schema.fields)).add("pearson_p", "double").add("spearman_p", "double")
    return found.mapInArrow(with_chances, schema)


def spearman_matrix(df: DataFrame, columns: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Rank correlation of each pair of columns over the rows where both are known, as (column_a, column_b, ...).

    A column is ranked once over its known rows, which serves every partner that is known wherever the column is; only
    for partners with gaps of their own it is ranked again. So complete columns shuffle rows * columns, not rows * pairs.
    """
    columns = list(columns)
    values = [f"_x{i}" for i in range(len(columns))]
    base = df.select(*[(nan_to_null(c) + 0.0).alias(x) for c, x in zip(columns, values)])
    # written down, so that a row keeps its number however often it is read
    base = materialise(base.withColumn("_row", F.monotonically_increasing_id()), "spearman")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]

    def known(*numbers: int) -> Column:
        return F.count_if(all_of([F.col(values[i]).isNotNull() for i in numbers]))

    counts = base.agg(
        *[known(i).alias(f"n{i}") for i in range(len(columns))], *[known(i, j).alias(f"n{i}_{j}") for i, j in pairs]
    ).first()
    # slots: a column's ranks over all its known rows, or over those where a partner is known too
    slots: list[tuple[int, int | None]] = [(i, None) for i in range(len(columns))]
    slot_of = {}
    for i, j in pairs:
        for own, other in ((i, j), (j, i)):
            if counts[f"n{own}"] == counts[f"n{i}_{j}"]:
                slot_of[own, other] = own
            else:
                slot_of[own, other] = len(slots)
                slots.append((own, other))

    cuts = fit_cuts(base, values, rows_per_bucket)
    wide = base
    for i, x in enumerate(values):
        wide = with_bucket(wide, x, cuts[x], f"_b{i}")
    cells = []
    for n, (i, j) in enumerate(slots):
        value = F.col(values[i]) if j is None else F.when(F.col(values[j]).isNotNull(), F.col(values[i]))
        cells.append(F.struct(F.lit(n).alias("slot"), value.alias("value"), F.col(f"_b{i}").alias("bucket")))
    rows = wide.select("_row", F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    slot_cuts = {n: cuts[values[i]] for n, (i, _) in enumerate(slots)}
    weighted = rows.withColumn("weight", F.lit(1).cast("long"))
    ranked = centred_ranks(weighted, "value", "weight", "slot", "rank", slot_cuts, "bucket", ["_row"], rows)
    wide = spread(ranked, sum(c.rows for c in slot_cuts.values()), "_row").groupBy("_row").agg(
        *[F.max(F.when(F.col("slot") == n, F.col("rank"))).alias(f"r{n}") for n in range(len(slots))]
    )
    sums = []
    for i, j in pairs:
        a, b = F.col(f"r{slot_of[i, j]}"), F.col(f"r{slot_of[j, i]}")
        both = a.isNotNull() & b.isNotNull()
        name = f"{i}_{j}"
        sums += [F.count_if(both).alias(f"n{name}"), F.sum(F.when(both, a * a)).alias(f"a{name}")]
        sums += [F.sum(F.when(both, b * b)).alias(f"b{name}"), F.sum(F.when(both, a * b)).alias(f"c{name}")]
    moments = wide.agg(*sums)
    table = [
        F.struct(
            F.lit(columns[i]).alias("column_a"),
            F.lit(columns[j]).alias("column_b"),
            F.col(f"n{i}_{j}").alias("observations"),
            F.col(f"a{i}_{j}").alias("va"),
            F.col(f"b{i}_{j}").alias("vb"),
            F.col(f"c{i}_{j}").alias("cov"),
        )
        for i, j in pairs
    ]
    cells = moments.select(F.inline(F.array(*table)))
    return cells.select("column_a", "column_b", "observations", _correlation().alias("spearman"))


def two_sided_p_value(r: float | None, n: int) -> float | None:
    """Chance of a correlation this far from 0 in n independent rows: Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    if r == 0:
        return 1.0
    # P(|T| > t) is the regularised incomplete beta function I_x(a, 1/2) at x = 1 - r^2, a = (n - 2) / 2
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def fraction(a: float, b: float, x: float) -> float:
        """Lentz's evaluation of the continued fraction of the incomplete beta function."""
        tiny = 1e-300
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
        h = d
        for m in range(1, 1_000_000):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                return h
        raise RuntimeError("the continued fraction of the incomplete beta function did not converge")

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b
