"""Joins and lags on the loan key when a few loans hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.operators.order import BUCKET, fit_cuts, with_bucket
from lossgrid.session import setting

# rows of one key that a task can take; the session setting lossgrid.rowsPerTask comes before it
ROWS_PER_TASK = 2_000_000
# most items that Spark's sketch of frequent items can track
SKETCH_LIMIT = 1 << 20
SALTS = "_salts"
# columns that tell the rows of one loan apart, as far as a table has them
SPREAD = ("monthly_reporting_period", "observation_month", "default_month", "record_id", "current_actual_upb")


def hot_keys(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame | None:
    """(key, salts) for every key with more rows than a task can take, or None if there cannot be any.

    The bound is a number of rows, whatever the table's size. A table with no more rows than that needs no look at its
    keys. Else frequent-items sketches, one for each of as many hashed parts of the keys as it takes for their error to
    stay below half the bound, so no key over the bound is missed; a key over half of it may be listed too. A part that
    a key found in it makes too large is looked at again without the keys found. A key's salts follow its estimated
    rows. The list has at most 2 * rows / rows_per_task entries and only steers where rows are processed.
    """
    limit = rows_per_task or setting(df.sparkSession, "rowsPerTask", ROWS_PER_TASK)
    n = df.count()
    if n <= limit:
        return None
    found: dict = {}
    kind = df.schema[key].dataType.simpleString()
    rest = df.select(key).where(F.col(key).isNotNull())
    while True:
        # 8 items for each time that the bound goes into the rows keep a sketch's error below half of it
        parts = max(1, -(-8 * n // limit // SKETCH_LIMIT))
        items = min(SKETCH_LIMIT, 1 << (8 * n // limit).bit_length())
        most = min(items, 2 * n // limit + 1)
        sketch = F.expr(f"approx_top_k(`{key}`, {most}, {items})").alias("top")
        part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
        tables = rest.groupBy(part).agg(F.count(F.lit(1)).alias("n"), sketch).collect()  # `parts` rows of hot keys
        new = {r["item"]: r["count"] for t in tables for r in t["top"] if 2 * r["count"] > limit and r["item"] not in found}
        found |= new
        unsure = max((t["n"] for t in tables), default=0) * 8 > limit * items
        if not (unsure and new):
            break
        taken = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in found], f"`{key}` {kind}"))
        rest = df.select(key).where(F.col(key).isNotNull()).join(taken, key, "left_anti")
        n = rest.count()
    if not found:
        return None
    rows = [(k, -(-2 * c // limit)) for k, c in found.items()]
    return df.sparkSession.createDataFrame(rows, f"`{key}` {kind}, {SALTS} long")


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Many-to-one equi join whose hot keys are split over as many groups as they have salts.

    Only the right rows of hot keys are repeated (`right` has one row per key). The hot table is broadcast: it has one
    row per few million rows of the data. The salt hashes a few columns only: the optimizer's work grows quickly with
    the columns a join key is made of.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"cannot salt the right side of a {how} join")
    if hot is None:
        return left.join(right, key, how)
    salts = F.coalesce(F.col(SALTS), F.lit(1))
    spread_by = [c for c in SPREAD if c in left.columns] or left.columns
    table = F.broadcast(hot.select(key, SALTS))
    spread = left.join(table, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts)).drop(SALTS)
    copies = F.sequence(F.lit(0).cast("long"), salts - 1)
    repeated = right.join(table, key, "left").withColumn("_salt", F.explode(copies)).drop(SALTS)
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def previous_value(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
    hot: DataFrame | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """`lag(column) over (partition by key order by order)` for several columns.

    A hot key is cut along its order into buckets. Inside a bucket it is a plain lag; the first row of a bucket takes
    the last row of the nearest bucket before it, read from a table with one row per hot key and bucket.
    """
    if hot is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in columns])

    is_hot = F.col("_hot").isNotNull()
    df = df.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left").select(*df.columns, "_hot")
    # the order columns are folded bucket by bucket: months first, then the finer columns inside a month
    parts = df
    rows_per_bucket = rows_per_bucket or setting(df.sparkSession, "rowsPerTask", ROWS_PER_TASK) // 4
    sub: list[str] = []
    cuts = fit_cuts(df.where(is_hot), list(order), rows_per_bucket)
    for i, c in enumerate(order):
        name = f"_part{i}"
        if i == 0 and len(order) > 1:
            # a whole value of the leading column never shares a bucket with another one, so finer buckets nest in it
            parts = parts.withColumn(name, F.when(is_hot, F.col(c).cast("long")).otherwise(0))
        else:
            parts = with_bucket(parts.withColumn("_o", F.col(c).cast("double")), "_o", cuts[c])
            parts = parts.withColumn(name, F.when(is_hot, F.col(BUCKET)).otherwise(0)).drop("_o", BUCKET)
        sub.append(name)
        if i == 1:
            break
    w = Window.partitionBy(key, *sub).orderBy(*order)
    inside = parts.select(
        "*",
        F.row_number().over(w).alias("_at"),
        *[F.lag(c).over(w).alias(prefix + c) for c in columns],
    )
    last = (
        parts.where(is_hot)
        .groupBy(key, *sub)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    )
    # one row per hot key and bucket; joined on the window's own partitioning, so nothing is shuffled again
    carried = last.select(
        key, *sub, F.lag("_last").over(Window.partitionBy(key).orderBy(*sub)).alias("_carry")
    )
    joined = inside.join(carried, [key, *sub], "left")
    return joined.select(
        *[c for c in df.columns if c != "_hot"],
        *[
            F.when((F.col("_at") == 1) & is_hot, F.col(f"_carry.{c}")).otherwise(F.col(prefix + c)).alias(prefix + c)
            for c in columns
        ],
    )
