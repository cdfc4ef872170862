"""Global order without a global sort in one task.

Ranks, running totals and exact quantiles all need a total order over every row. A window without a partition would
send all rows to a single task, so the value range is cut into buckets first:

1. one pass over the column gives its row count and a mergeable quantile sketch (a few kilobytes on the driver);
2. the sketch yields cut points, as many as the row count asks for; beyond what one sketch resolves, buckets that are
   still too full get sketches of their own until all fit. Cuts only steer partitioning: a poor one makes buckets
   uneven, never results wrong;
3. a value so frequent that it fills whole buckets gets a bucket of its own, in which every row has the same rank;
4. each bucket is ordered by itself, and the totals of the buckets before it are added as an offset.

Cut points travel as literals, so a lost executor recomputes the same buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.functions.scalars import any_of, nan_to_null
from lossgrid.session import materialise, setting

# the session setting lossgrid.rowsPerBucket comes before it
ROWS_PER_BUCKET = 1_000_000
# cuts that one sketch resolves evenly, and its size; fuller buckets are cut again
SKETCH_CUTS = 2048
SKETCH_SIZE = 16384
# sketches that are queried in one statement
SKETCHES_AT_ONCE = 64
# of so many even cuts, those that fall on one value show that it is frequent
FREQUENT_CUTS = 512
# offsets (one row per bucket) are broadcast up to this many
BROADCAST_BUCKETS = 100_000
BUCKET = "_bucket"
# rows of a task on average, where shuffles that order rows take more tasks than the session's number
ROWS_PER_TASK = 250_000
MOST_TASKS = 50_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Shuffled by the keys into so many tasks that what one of them holds does not grow with the `rows`."""
    tasks = min(MOST_TASKS, math.ceil(rows / setting(df.sparkSession, "rowsPerTask", ROWS_PER_TASK)))
    few = tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*keys) if few else df.repartition(tasks, *keys)


class Cuts(NamedTuple):
    rows: int
    points: tuple[float, ...] = ()
    heavy: tuple[float, ...] = ()
    salts: int = 1
    # values with a visible share of the rows, which are worth combining before they are shuffled
    frequent: tuple[float, ...] = ()

    @property
    def splits(self) -> list[float]:
        """Ascending bucket borders; a heavy value v is fenced in by v and the next larger double."""
        borders = set(self.points) | {math.nextafter(v, math.inf) for v in self.heavy}
        return [-math.inf, *sorted(borders), math.inf]

    @property
    def heavy_buckets(self) -> list[int]:
        place = {v: i for i, v in enumerate(self.splits)}
        return [place[v] for v in self.heavy]


def _quantiles_of(spark, sketches: Mapping, buckets: Mapping) -> dict:
    """Evenly spaced quantiles of each sketch; a query on literals, without a job over data."""
    wanted = {c: b for c, b in buckets.items() if b > 1 and sketches[c] is not None}
    if not wanted:
        return {}
    names = list(wanted)
    exprs = []
    for i, c in enumerate(names):
        ranks = ",".join(f"{j / wanted[c]!r}D" for j in range(1, wanted[c]))
        exprs.append(f"kll_sketch_get_quantile_double(:s{i}, array({ranks})) AS q{i}")
    sketch_args = {f"s{i}": bytearray(sketches[c]) for i, c in enumerate(names)}
    row = spark.sql(f"SELECT {', '.join(exprs)}", args=sketch_args).first()
    return {c: list(row[f"q{i}"]) for i, c in enumerate(names)}


def _from_quantiles(values: Sequence[float]) -> tuple[set[float], Counter]:
    """Cut points, and the values that fill whole buckets with the number of their cuts."""
    counts = Counter(v + 0.0 for v in values)
    points = {v for v in counts if math.isfinite(v)}
    return points, Counter({v: k for v, k in counts.items() if k > 1 and v in points})


def fit_cuts(
    df: DataFrame, columns: Sequence[str], rows_per_bucket: int | None = None, frequent: bool = False
) -> dict[str, Cuts]:
    """Cut points for each numeric column, so that about `rows_per_bucket` rows lie in a bucket at any size, and with
    `frequent` the values that many rows share.

    One aggregation; only the sketches reach the driver. Where a column needs more than SKETCH_CUTS buckets, the
    buckets that are too full are cut again, one more aggregation per level.
    """
    size = rows_per_bucket or setting(df.sparkSession, "rowsPerBucket", ROWS_PER_BUCKET)
    aggs = []
    for i, c in enumerate(columns):
        x = nan_to_null(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias(f"s{i}"),
        ]
    row = df.agg(*aggs).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    wanted = {c: max(1, math.ceil(n / size)) for c, n in counts.items()}
    buckets = {c: min(SKETCH_CUTS, n) for c, n in wanted.items()}
    sketches = {(c, kind): row[f"s{i}"] for i, c in enumerate(columns) for kind in ("cuts", "frequent")}
    asked = {(c, "cuts"): n for c, n in buckets.items()}
    if frequent:
        asked |= {(c, "frequent"): min(FREQUENT_CUTS, n) for c, n in counts.items()}
    quantiles = _quantiles_of(df.sparkSession, sketches, asked)
    out = {}
    for c in columns:
        points, heavy = _from_quantiles(quantiles.get((c, "cuts"), []))
        often = set(heavy) | set(_from_quantiles(quantiles.get((c, "frequent"), []))[1])
        # a cut stands for more than `size` rows where there are fewer cuts than buckets wanted
        salts = max(heavy.values(), default=0) * math.ceil(wanted[c] / buckets[c]) + 1
        out[c] = Cuts(counts[c], tuple(sorted(points)), tuple(sorted(heavy)), salts, tuple(sorted(often)))
        if wanted[c] > SKETCH_CUTS:
            out[c] = _refined(df.select((nan_to_null(c) + 0.0).alias(c)).dropna(), c, out[c], size)
    return out


def _refined(df: DataFrame, column: str, cuts: Cuts, size: int) -> Cuts:
    """Cut every bucket again that holds over twice `size` rows, until none does or no cut is left to make.

    At most rows / size buckets are too full, so as many sketches reach the driver, SKETCHES_AT_ONCE at a time.
    """
    while True:
        whole = cuts.heavy_buckets
        full = (
            with_bucket(df, column, cuts)
            .where(~F.col(BUCKET).isin(whole) if whole else F.lit(True))
            .groupBy(BUCKET)
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min(column).alias("low"),
                F.max(column).alias("high"),
                F.kll_sketch_agg_double(column, F.lit(SKETCH_SIZE)).alias("sketch"),
            )
            .where(F.col("n") > 2 * size)
            .orderBy(BUCKET)
        )
        points, heavy, salts = set(cuts.points), set(cuts.heavy), cuts.salts
        part: list = []

        def take(part: list) -> int:
            found, wanted = {}, {}
            for r in part:
                name = str(r[BUCKET])
                if r["low"] == r["high"]:  # one value fills the bucket
                    heavy.add(r["low"])
                    points.add(r["low"])
                    wanted[name] = 0
                else:
                    found[name], wanted[name] = r["sketch"], min(SKETCH_CUTS, math.ceil(r["n"] / size))
            most = max((math.ceil(r["n"] / size) for r in part), default=1)
            for values in _quantiles_of(df.sparkSession, found, {c: wanted[c] for c in found}).values():
                new, repeated = _from_quantiles(values)
                points.update(new)
                heavy.update(repeated)
            return most

        for r in full.toLocalIterator():
            part.append(r)
            if len(part) == SKETCHES_AT_ONCE:
                salts, part = max(salts, take(part) + 1), []
        if part:
            salts = max(salts, take(part) + 1)
        if points == set(cuts.points) and heavy == set(cuts.heavy):
            return cuts
        cuts = Cuts(cuts.rows, tuple(sorted(points)), tuple(sorted(heavy)), salts, tuple(sorted({*cuts.frequent, *heavy})))


def with_bucket(df: DataFrame, column: str, cuts: Cuts, out: str = BUCKET) -> DataFrame:
    """Bucket number of a non-missing double column; larger values never get a smaller number."""
    return _bucketed(df, column, cuts.splits, out)


def _bucketed(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    if len(splits) <= 2:
        return df.withColumn(out, F.lit(0))
    bucketed = Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)
    return bucketed.withColumn(out, F.col(out).cast("int"))


def running_totals(
    df: DataFrame,
    key: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    cuts: Cuts | None = None,
    rows_per_bucket: int | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """One row per (by, distinct key): the totals of `sums` on that key and, as `<name>_before`, on all keys before it.

    Rows are shuffled once, by bucket; in a bucket ties are collapsed and ordered. Frequent keys are combined before
    that, so a key that holds most of the rows costs a few rows. Rows whose key or group is missing have no place in the
    order and are left out. Without `cuts` the few columns needed are written down first, as they are read twice.
    """
    return ordered_totals(df, key, sums, by, descending, cuts, rows_per_bucket, keep_bucket)[0]


def ordered_totals(
    df: DataFrame,
    key: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    cuts: Cuts | None = None,
    rows_per_bucket: int | None = None,
    keep_bucket: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The running totals, and one row with the grand totals of `sums` from the same shuffle."""
    by, names = list(by), list(sums)
    base = df.select(*by, (nan_to_null(key) + 0.0).alias(key), *[sums[n].alias(n) for n in names]).dropna(
        subset=[*by, key]
    )
    if cuts is None:
        base = materialise(base, "ordered")
        cuts = fit_cuts(base, [key], rows_per_bucket, frequent=True)[key]
    base, group = with_bucket(base, key, cuts), [*by, BUCKET]
    added = [F.sum(n).alias(n) for n in names]
    if cuts.frequent:
        often = F.col(key).isin(list(cuts.frequent))
        base = base.where(~often).unionByName(base.where(often).groupBy(*group, key).agg(*added))
    # known to hold, but the join below would infer it for one of its branches only, which then shuffled anew
    for c in group:
        base = base.where(F.col(c).isNotNull())
    ties = spread(base, cuts.rows, *group).groupBy(*group, key).agg(*added)
    whole = ties.agg(*added)

    def ordered(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy(*group).orderBy(ordered(key)).rowsBetween(Window.unboundedPreceding, -1)
    rows = ties.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_before") for n in names]
    )
    shown = [BUCKET] if keep_bucket else []
    if not cuts.points:
        return rows.select(*shown, *by, key, *names, *[f"{n}_before" for n in names]), whole

    # from the ties, whose shuffle is computed once for all branches
    totals = ties.groupBy(*group).agg(*[F.sum(n).alias(f"_{n}") for n in names])
    # one row per bucket in each group
    across = Window.partitionBy(*by).orderBy(ordered(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_{n}_offset") for n in names]
    )
    if not by and len(cuts.splits) <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)  # one row per bucket
    joined = rows.join(offsets, group)
    before = [(F.col(f"{n}_before") + F.col(f"_{n}_offset")).alias(f"{n}_before") for n in names]
    return joined.select(*shown, *by, key, *names, *before), whole


def centred_ranks(
    df: DataFrame,
    value: str,
    weight: str,
    by: str,
    out: str,
    cuts: Mapping[int, Cuts],
    bucket: str,
    salted_by: Sequence[str],
    rows: DataFrame,
) -> DataFrame:
    """Add the mean rank of `value` inside each group, less the mean of all ranks of the group.

    Rows are distinct and count `weight` times; `rows` are the rows they were combined from. `bucket` holds the value's bucket by the cuts of its group. Ties share
    their mean rank, so a constant group is exactly 0. A heavy value has one known rank: its rows are spread over salted
    groups by the columns `salted_by`.
    """
    heavy = [
        (F.col(by) == g) & F.col(bucket).isin(c.heavy_buckets) for g, c in cuts.items() if c.heavy
    ]
    loose = any_of(heavy) if heavy else F.lit(False)
    salt = F.pmod(F.xxhash64(*salted_by), F.lit(max(c.salts for c in cuts.values()))).cast("int")
    # a constant salt would be folded away, and the windows would not know the rows' place any more
    group = [by, bucket, "_salt"] if heavy else [by, bucket]
    upto_peers = Window.partitionBy(*group).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    salted = df.withColumn("_salt", F.when(loose, salt).otherwise(0))
    ranked = spread(salted, sum(c.rows for c in cuts.values()), *group).select(
        "*",
        F.sum(weight).over(upto_peers).alias("_upto"),
        F.sum(weight).over(Window.partitionBy(*group, value)).alias("_ties"),
    )
    inside = F.col("_upto") - (F.col("_ties") - 1) / 2
    before = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(
        by,
        bucket,
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(by)).alias("_all"),
    )
    # one row per group and bucket; a shuffled join would bring all rows of a bucket together again
    if sum(len(c.splits) for c in cuts.values()) <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    joined = ranked.join(offsets, [by, bucket])
    rank = F.col("_before") + F.when(loose, (F.col("_n") + 1) / 2).otherwise(inside) - (F.col("_all") + 1) / 2
    return joined.select(*df.columns, rank.alias(out))


def _interpolate(low: float, high: float, fraction: float) -> float:
    """Linear interpolation, exact at both ends."""
    if fraction >= 0.5:
        return high - (high - low) * (1 - fraction)
    return low + (high - low) * fraction


def _long(
    clean: DataFrame, columns: Sequence[str], borders: Mapping[str, list[float]], keep_value: bool = False
) -> DataFrame:
    """(feature number, bucket[, value], weight) for every known value of the columns."""
    wide = clean.select(*columns, "_w")
    cells = []
    for i, c in enumerate(columns):
        wide = _bucketed(wide, c, borders[c], f"_b{i}")
        fields = [F.lit(i).alias("feature"), F.when(F.col(c).isNotNull(), F.col(f"_b{i}")).alias("bucket")]
        cells.append(F.struct(*fields, *([F.col(c).alias("value")] if keep_value else [])))
    return wide.select(F.inline(F.array(*cells)), "_w").where(F.col("bucket").isNotNull())


def _holds(positions: Sequence[int]) -> Column:
    """Does the run of rows [before, before + n) hold one of the positions?"""
    return F.exists(
        F.array(*[F.lit(k) for k in positions]), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))
    )


def row_weight(weight: str | None) -> Column:
    """How many rows a row stands for: a whole number, 1 without a weight, 0 where it is missing or negative."""
    return F.lit(1).cast("long") if weight is None else F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0))


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of several columns, exact at any size; None for a column without values.

    With `weight` every row counts that many times, as if it were repeated.

    Selection instead of sorting: bucket counts (combined map-side) tell which buckets hold the wanted order
    statistics, and only the rows of those buckets are collapsed and ordered.
    """
    names = list(wanted)
    columns = [f"_x{i}" for i in range(len(names))]
    clean = df.select(*[(nan_to_null(c) + 0.0).alias(x) for c, x in zip(names, columns)], row_weight(weight).alias("_w"))
    if weight is not None:
        clean = clean.where(F.col("_w") > 0)
    cuts = fit_cuts(clean, columns, rows_per_bucket)
    sizes = {c: cuts[c].rows for c in columns}
    if weight is not None:
        sums = [F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))), F.lit(0)).alias(c) for c in columns]
        sizes = clean.agg(*sums).first().asDict()
    probs = dict(zip(columns, wanted.values()))
    spots = {c: [(sizes[c] - 1) * p for p in probs[c]] if sizes[c] else [] for c in columns}
    positions = {c: sorted({k for s in spots[c] for k in (math.floor(s), math.ceil(s))}) for c in columns}

    # ranges to look into: (column, low, high, rows before)
    targets: list[tuple[str, float, float, int]] = []
    targets += [(c, -math.inf, math.inf, 0) for c in columns if not cuts[c].points and cuts[c].rows]
    cut_columns = [c for c in columns if cuts[c].points]
    if cut_columns:
        counts = (
            _long(clean, cut_columns, {c: cuts[c].splits for c in cut_columns})
            .groupBy("feature", "bucket")
            .agg(F.sum("_w").alias("n"))
        )
        upto = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        inside = any_of([(F.col("feature") == i) & _holds(positions[c]) for i, c in enumerate(cut_columns)])
        for row in counts.where(inside).collect():  # at most two rows per wanted quantile
            c, b = cut_columns[row["feature"]], row["bucket"]
            targets.append((c, cuts[c].splits[b], cuts[c].splits[b + 1], row["before"]))
    if not targets:
        return {c: None for c in names}

    found_columns = list(dict.fromkeys(c for c, _, _, _ in targets))
    borders = {
        c: sorted({-math.inf, math.inf, *[b for t in targets if t[0] == c for b in t[1:3]]}) for c in found_columns
    }
    spot_of = {
        (found_columns.index(c), borders[c].index(low)): t for t, (c, low, _, _) in enumerate(targets)
    }
    wanted_buckets = any_of(
        [
            (F.col("feature") == i) & F.col("bucket").isin([b for f, b in spot_of if f == i])
            for i in range(len(found_columns))
        ]
    )
    before = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ties = (
        _long(clean, found_columns, borders, keep_value=True)
        .where(wanted_buckets)
        .groupBy("feature", "bucket", "value")
        .agg(F.sum("_w").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    needed = []
    for (f, b), t in spot_of.items():
        c, _, _, skipped = targets[t]
        local = [k - skipped for k in positions[c] if k >= skipped]
        if local:
            needed.append((F.col("feature") == f) & (F.col("bucket") == b) & _holds(local))
    found: dict[str, list[tuple[int, int, float]]] = {c: [] for c in columns}
    for row in ties.where(any_of(needed)).collect():  # at most two rows per wanted quantile
        c, _, _, skipped = targets[spot_of[(row["feature"], row["bucket"])]]
        start = row["before"] + skipped
        found[c].append((start, start + row["n"], row["value"]))

    def statistic(c: str, k: int) -> float:
        return next(v for start, end, v in found[c] if start <= k < end)

    out: dict[str, list[float] | None] = {}
    for name, c in zip(names, columns):
        out[name] = None
        if cuts[c].rows:
            out[name] = [
                _interpolate(statistic(c, math.floor(s)), statistic(c, math.ceil(s)), s - math.floor(s))
                for s in spots[c]
            ]
    return out


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    rows_per_bucket: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(by, prob, quantile): the interpolated quantiles of every group, exact for any number and size of groups.

    One running total over (group, bucket) serves all groups; nothing reaches the driver but the cut points. Groups of
    null and groups without a known value have no row.
    """
    by, probs = list(by), [float(p) for p in probs]
    rows = df.where(row_weight(weight) > 0)
    table = running_totals(rows, value, {"n": row_weight(weight)}, by, rows_per_bucket=rows_per_bucket)
    table = materialise(table, "grouped-order")  # one row per group and distinct value
    sizes = table.groupBy(*by).agg(F.sum("n").alias("_all"))
    wanted = F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob")
    spots = sizes.select(*by, wanted, "_all").withColumn("_at", (F.col("_all") - 1) * F.col("prob"))
    low, high = F.floor("_at"), F.ceil("_at")
    held = lambda k: (k >= F.col("n_before")) & (k < F.col("n_before") + F.col("n"))
    found = table.join(spots, by).where(held(low) | held(high))
    ends = found.groupBy(*by, "prob").agg(
        F.max(F.when(held(low), F.col(value))).alias("_low"),
        F.max(F.when(held(high), F.col(value))).alias("_high"),
        F.first(F.col("_at") - low).alias("_part"),
    )
    a, b, part = F.col("_low"), F.col("_high"), F.col("_part")
    # exact at both ends
    between = F.when(part >= 0.5, b - (b - a) * (1 - part)).otherwise(a + (b - a) * part)
    return ends.select(*by, "prob", F.when(a == b, a).otherwise(between).alias("quantile"))
