"""The corpus pipeline: stages over `documents`, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, lookup, maybe_broadcast, read_table
from lossgrid.llm.decontaminate import contained_items
from lossgrid.llm.line_dedup import remove_repeated_passages
from lossgrid.llm.packing import pack_documents
from lossgrid.llm.quality import fit, score
from lossgrid.llm.simhash import near_dedup

# texts that the last stage encodes at a time: its executors also hold what the stages before it have left behind
PACKING_BYTES = 1 << 20


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number of its own for every row, as ids may be null or repeat. Written down, so that each reading
    of it gives a row the same number."""
    key = _unused("row_key", docs)
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`rows` but those with a key of `gone`. Few keys go to the rows, so that the texts stay where they are."""
    gone = keep(gone, "pipeline-gone")
    return rows.join(maybe_broadcast(gone, gone.count()), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go."""
    scored = score(docs, fit(docs, read_table(spark, folder, "labels")))
    return scored.where(F.col("score") >= 0.5).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts lose the passages of lines that an earlier place has; n_chars follows, and documents left blank go."""
    removed = _unused("removed", docs)
    edited = remove_repeated_passages(docs, count_column=removed)
    stays = (F.col(removed) == 0) | (F.regexp_replace("text", r"\s", "") != "")
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return edited.where(stays).withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each SimHash group stays, whatever ids its rows have: the smallest doc_id (null last), then the
    smallest text hash; of rows that repeat both, one."""
    rows, key = _keyed(docs)
    groups = near_dedup(rows, key).select(F.col("doc_id").alias("member"), "component_id")
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), F.col(key).alias("key"))
    places = rows.select(place.alias("place"))
    members = places.join(groups, F.col("place.key") == F.col("member")).select("component_id", "place")
    members = keep(members, "pipeline-members")
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    others = lookup(members, first, "component_id", "inner").where("place.key <> first.key")
    return _without(rows, others.select(F.col("place.key").alias(key)), key)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The very rows that contain a benchmark item go, not others with their id."""
    rows, key = _keyed(docs)
    found = contained_items(rows, read_table(spark, folder, "benchmark"), doc_id=key)
    return _without(rows, found.select(F.col("doc_id").alias(key)).distinct(), key)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents left, packed into sequences of 1024 tokens."""
    return pack_documents(docs, pass_bytes=PACKING_BYTES)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# trained scores, passages of lines and token ids have no SQL form; tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each one's result is written and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
