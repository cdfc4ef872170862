"""Equal-frequency bins, exact-size selection and rank capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.fixed import SEED, TOP_PERCENTS
from lossgrid.functions.scalars import any_of, nan_to_null
from lossgrid.operators.order import ROWS_PER_BUCKET, exact_quantiles, fit_cuts, row_weight, running_totals
from lossgrid.session import materialise, setting


def quantile_edges(
    df: DataFrame, columns: Sequence[str], q: int, rows_per_bucket: int | None = None, weight: str | None = None
):
    """Distinct edges of q equal-frequency bins per column (an action; q + 1 numbers per column reach the driver)."""
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(df, {c: probs for c in columns}, rows_per_bucket, weight)
    return {c: sorted(set(e)) if e else [] for c, e in edges.items()}


def bin_number(column: str, edges: Sequence[float]) -> Column:
    """0-based right-closed bin of a double column without NaN; the lowest edge is in bin 0, a missing value in none."""
    out = F.lit(0)
    for edge in edges[1:-1]:
        out = out + (F.col(column) > F.lit(edge)).cast("int")
    return F.when(F.col(column).isNotNull(), out)


def qcut(
    df: DataFrame, column: str, q: int, out: str, rows_per_bucket: int | None = None, weight: str | None = None
) -> DataFrame:
    """Add the equal-frequency bin of `column`: equal values share a bin, repeated edges merge their bins. With `weight`
    a row counts that many times."""
    edges = quantile_edges(df, [column], q, rows_per_bucket, weight)[column]
    return df.withColumn("_x", nan_to_null(column)).withColumn(out, bin_number("_x", edges)).drop("_x")


def sample_order(key: Sequence[str], seed: int = SEED) -> Column:
    """A uniform order over rows that depends on nothing but the seed and the row's key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def take_first(
    df: DataFrame,
    stratum: str,
    quotas: dict,
    order: Column,
    digits: int = 4,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exactly `quotas[s]` rows of each stratum s (all of them if it has fewer), the first in a uniform hex order.

    Leading hex digits are ready-made equal buckets: those before the boundary bucket are taken whole, those after it
    not at all. While a boundary bucket holds more than `rows_per_bucket` rows it is split by the next digits; then its
    rows are numbered. Rows with the same key are told apart by a hash of all their columns. With `weight` a row is that
    many rows in succession: quotas count these, and in the result the column holds how many of them are taken.
    """
    size = rows_per_bucket or setting(df.sparkSession, "rowsPerBucket", ROWS_PER_BUCKET)
    known = [(s, n) for s, n in quotas.items() if n > 0]
    if not known:
        return df.limit(0)
    keyed = df.withColumn("_order", order).where(F.col(stratum).isin([s for s, _ in known]))
    if weight is not None:
        kind = df.schema[weight].dataType
        keyed = keyed.withColumn(weight, row_weight(weight).cast(kind)).where(F.col(weight) > 0)
    copies = row_weight(weight)
    same = {s: F.col(stratum) == F.lit(s) for s, _ in known}
    length = 0
    # per stratum: the prefix of the boundary bucket, and how many of its rows are taken
    limits: dict = {s: ("", n) for s, n in known}
    open_strata = [s for s, _ in known]
    while open_strata:
        length += digits
        left = F.lit(None).cast("long")
        for s in open_strata:
            left = F.when(same[s], F.lit(limits[s][1]).cast("long")).otherwise(left)
        inside = any_of([same[s] & F.col("_order").startswith(limits[s][0]) for s in open_strata])
        counts = (
            keyed.where(inside)
            .withColumn("_left", left)
            .groupBy(stratum, "_left", F.substring("_order", 1, length).alias("_prefix"))
            .agg(F.sum(copies).alias("_n"), F.count(F.lit(1)).alias("_rows"))
        )
        # at most 16 ** digits rows in each stratum
        w = Window.partitionBy(stratum).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        border = counts.where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left")))
        found = {r[stratum]: r for r in border.collect()}  # one row per stratum
        following = []
        for s in open_strata:
            r = found.get(s)
            if r is None:  # fewer rows than wanted: all of the stratum
                limits[s] = None
                continue
            limits[s] = (r["_prefix"], r["_left"] - r["_before"])
            if r["_rows"] > size and length < 32:
                following.append(s)
        open_strata = following

    whole, edge, remaining = [], [], F.lit(0)
    for s, _ in known:
        if limits[s] is None:
            whole.append(same[s])
            continue
        prefix, n = limits[s]
        cut = F.substring("_order", 1, len(prefix))
        whole.append(same[s] & (cut < prefix))
        edge.append(same[s] & (cut == prefix))
        remaining = F.when(same[s], F.lit(n)).otherwise(remaining)
    taken = keyed.where(any_of(whole)).select(*df.columns)
    if not edge:
        return taken
    total = Window.partitionBy(stratum).orderBy("_order", F.xxhash64(*df.columns))
    upto = total.rowsBetween(Window.unboundedPreceding, 0)
    numbered = keyed.where(any_of(edge)).withColumn("_at", F.sum(copies).over(upto)).where(F.col("_at") - copies < remaining)
    if weight is not None:
        part = F.least(copies, remaining - F.col("_at") + copies)
        numbered = numbered.withColumn(weight, part.cast(kind))
    return taken.unionByName(numbered.select(*df.columns))


def capture_lift(
    df: DataFrame,
    score: str,
    label: str,
    key: Sequence[str],
    percents: Sequence[int] = TOP_PERCENTS,
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Defaults among the top share of rows by score, as a rate of all defaults and as a lift over the average.

    Rows without a score or a label count nowhere; with `weight` a row counts that many times. The columns needed are
    written down once, then read for the cuts, the totals and the ties at the cuts. Rows are never numbered: the score groups and their running totals decide all but the last, partly included group
    of each cut; there the first rows in a uniform order of the key count (the order of ties is open in the source).
    """
    names = list(key)
    key = [f"_key{i}" for i in range(len(names))]
    df = df.where(F.col(label).isNotNull()).select(
        (nan_to_null(score) + 0.0).alias("_score"),
        F.col(label).cast("long").alias("_y"),
        row_weight(weight).alias("_w"),
        *[F.col(c).alias(k) for c, k in zip(names, key, strict=True)],
    )
    score = "_score"
    df = materialise(df.where(F.col(score).isNotNull() & (F.col("_w") > 0)), "capture")
    cuts = fit_cuts(df, [score], rows_per_bucket, frequent=True)[score]
    total = cuts.rows if weight is None else df.agg(F.sum("_w")).first()[0] or 0
    groups = running_totals(df, score, {"n": F.col("_w"), "pos": F.col("_y") * F.col("_w")}, descending=True, cuts=cuts)
    sizes = {p: total * p // 100 for p in percents}
    # the last score's group tells the total of the defaults
    hit = any_of(
        [(F.col("n_before") < n) & (F.col("n_before") + F.col("n") >= n) for n in [*sizes.values(), total]]
    )
    borders = groups.where(hit).collect()  # at most one score per cut
    defaults = max((b["pos_before"] + b["pos"] for b in borders), default=0)

    rows, partial = [], {}
    for p, n in sizes.items():
        border = next((b for b in borders if b["n_before"] < n <= b["n_before"] + b["n"]), None)
        captured = border["pos_before"] if border else 0
        if border and n == border["n_before"] + border["n"]:
            captured += border["pos"]
        elif border:
            partial[p] = (border[score], n - border["n_before"])
        rows.append((p, n, captured))
    cells = [
        F.struct(
            F.lit(p).alias("top_percent"),
            F.lit(n).cast("long").alias("observations"),
            F.lit(captured).cast("long").alias("whole_groups"),
        )
        for p, n, captured in rows
    ]
    table = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    if partial:
        at_cut = F.array(*[F.when(F.col(score) == F.lit(s), F.lit(p)) for p, (s, _) in partial.items()])
        tied = df.select(F.explode(F.array_compact(at_cut)).alias("top_percent"), "_y", "_w", *key)
        rest = {p: r for p, (_, r) in partial.items()}
        taken = take_first(tied, "top_percent", rest, sample_order(key), weight=None if weight is None else "_w")
        extra = taken.groupBy("top_percent").agg(F.sum(F.col("_y") * F.col("_w")).cast("long").alias("_extra"))
        table = table.join(extra, "top_percent", "left")  # one row per cut
    else:
        table = table.withColumn("_extra", F.lit(0).cast("long"))
    captured = F.col("whole_groups") + F.coalesce(F.col("_extra"), F.lit(0))
    rate = F.try_divide(captured.cast("double"), F.col("observations"))
    return table.select(
        "top_percent",
        "observations",
        captured.alias("defaults_captured"),
        F.lit(defaults).cast("long").alias("total_defaults"),
        F.try_divide(captured.cast("double"), F.lit(defaults)).alias("capture_rate"),
        F.try_divide(rate, F.lit(defaults / total if total else None).cast("double")).alias("lift"),
    )
