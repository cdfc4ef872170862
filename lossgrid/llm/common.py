"""Helpers shared by the training-data operators: written intermediate tables and joins that split hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgrid.session import materialise, shared_folder

# a key with at least this share of all rows is treated apart; so at most 1 / HOT_SUPPORT keys are ever broadcast
HOT_SUPPORT = 1e-3
# intermediate tables with fewer rows than this may be broadcast; beyond it the same join shuffles
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    return materialise(df, label)


def text_or_empty(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def frequent(df: DataFrame, key: str, support: float = HOT_SUPPORT) -> DataFrame:
    """Misra-Gries candidates: every value of `key` with over `support` of the rows, and at most 1 / support values."""
    found = df.stat.freqItems([key], support)
    return found.select(F.explode(f"`{key}_freqItems`").alias(key)).distinct()


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """`df` joined to `table`, which has one row per key; keys that hold a large part of `df` never share a task.

    The frequent keys' rows of `table` (at most 1 / HOT_SUPPORT) are broadcast, all other keys shuffle as usual. Both
    frames should be cheap to read again: they are scanned once per branch. Rows with a null key have no match. The
    frequent keys are written down before both branches read them, as another evaluation may find others.
    """
    hot = F.broadcast(keep(frequent(df, key) if hot is None else hot, "frequent-keys"))
    hot_rows = F.broadcast(table.join(hot, key, "left_semi"))
    mapped = df.join(hot, key, "left_semi").join(hot_rows, key, how)
    rest = df.join(hot, key, "left_anti").join(table, key, how)
    return mapped.unionByName(rest)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted `rows` stay within `limit`; else the plain frame, joined by shuffling."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, label: str = "components", rounds: int = 100) -> DataFrame:
    """(node, root) for all nodes of the undirected `edges` (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; every round is written to the shared folder. No link or component
    reaches the driver, only a row count and a checksum per round. Raises if `rounds` do not suffice.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = lookup(pairs, low, "u", "inner")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = keep(pairs, label)
    last = state(pairs)
    for _ in range(rounds):
        pairs = keep(star(keep(star(pairs, True), label), False), label)
        now = state(pairs)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
