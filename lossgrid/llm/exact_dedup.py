"""Exact dedup with a heavy-hitter split: frequent digests are resolved map-side, all others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import HOT_SUPPORT, frequent, keep, text_or_empty

# fixed values: the characters [\x20\x09-\x0D] that do not count when texts are compared
IGNORED = " \t\n\x0b\x0c\r"


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = HOT_SUPPORT
) -> DataFrame:
    """One row per document: which row of its group of equal texts stays.

    Texts are equal when they are identical without white space. Of equal texts the one with the most code points
    stays, then the smallest id; a null id loses against any other. A null text counts as empty. Rows that repeat both
    the kept id and its length are all kept: they are the same document. An empty table gives an empty result; other
    columns are neither read nor returned.

    Only (id, length, SHA-256) rows move. Misra-Gries finds the digests with over `support` of the rows; their winners
    are counted exactly, at most 1 / support rows, and broadcast. The remaining digests are grouped by a shuffle, in
    which no digest has more than that share.
    """
    keyed = keep(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.length(text_or_empty(text_column)).cast("long").alias("n_points"),
            F.sha2(F.translate(text_or_empty(text_column), IGNORED, ""), 256).alias("text_sha256"),
        ),
        "exact-dedup",
    )
    candidates = F.broadcast(keep(frequent(keyed, "text_sha256", support), "exact-dedup-hot"))

    def winners(rows: DataFrame) -> DataFrame:
        # ~id turns the order of ids round, so the largest struct has the smallest id and null ids come last
        best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("inverse"))).alias("best")
        return rows.groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))

    heavy = F.broadcast(winners(keyed.join(candidates, "text_sha256", "left_semi")))
    light = keyed.join(candidates, "text_sha256", "left_anti")
    rows = keyed.join(heavy, "text_sha256").unionByName(light.join(winners(light), "text_sha256"))
    keep_id = F.bitwise_not("best.inverse")
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_points") == F.col("best.n_points"))).alias("kept"),
        "text_sha256",
    )
