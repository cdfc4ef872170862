"""Readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossgrid.sources.schemas import ORIGINATION, PERFORMANCE

LOAN = "loan_identifier"
MONTH = "monthly_reporting_period"
ROWS_PER_FILE = 5_000_000


def read_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", sep: str = "|", header: bool = False
) -> DataFrame:
    """A table with a declared schema; text is trimmed, so blank-padded codes and empty fields become plain or NULL."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        df = reader.option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)
    else:
        df = reader.format(fmt).load(path)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in text})


def read_origination(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, ORIGINATION, fmt, **options)


def read_performance(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, PERFORMANCE, fmt, **options)


def write_performance(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet partitioned by month. Rows are gathered by month into partitions of the advisory size, so the tasks and
    files of a month follow its bytes: a large month is written by many tasks, small ones share one."""
    rows = df.hint("rebalance", MONTH)
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(MONTH).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = LOAN) -> None:
    """Save as a table bucketed and sorted by loan: joins of two such tables on the loan need no shuffle."""
    clustered = df.repartition(buckets, key)  # else every task writes a file into every bucket
    clustered.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Export with a header line in each part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files with a header line; a value that does not fit its type fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def load_features(
    source: DataFrame, columns: Sequence[str], keys: Sequence[str] = (LOAN, "observation_month")
) -> DataFrame:
    """The wanted columns of a table; the projection reaches the scan, whose splits stand in for chunks."""
    return source.select(*keys, *[c for c in columns if c not in keys])
