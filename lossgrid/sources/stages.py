"""Named stage tables, one directory per namespace, published whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lossgrid.session import create_empty, delete_folder, exists, names_in

NAMESPACES = ("raw", "pd", "lgd", "ecl")
# the file that makes a version count; it is created last
MARK = "_PUBLISHED"
# the start of the name of the file that tells the buckets of a version: their number and column follow
BUCKETED = "_BUCKETS-"
# buckets of a stage unless told otherwise; Spark takes at most 100 000
BUCKETS = 200
# published versions that stay: the newest one and the one that frames may still be reading
KEPT = 2


class StageCatalog:
    """Stage tables `namespace.name` as Parquet under a shared root folder.

    Every rebuild writes a folder of its own beside the earlier ones and marks it when it is complete. Readers take the
    newest marked one, so a rebuild that fails, or is still being written, leaves the stage as it was. Operators compose
    lazily, so a stage is only written where a result is used more than once or kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        """The folder that holds the versions of a stage."""
        namespace, _, table = name.partition(".")
        if namespace not in NAMESPACES or not table:
            raise ValueError(f"stage names look like one of {NAMESPACES} plus '.table', not {name!r}")
        return f"{self.root}/{namespace}/{table}"

    def versions(self, name: str) -> list[str]:
        """The folders of the published versions, oldest first."""
        folder = self.path(name)
        found = [f"{folder}/{v}" for v in names_in(self.spark, folder) if v.startswith("v-")]
        return [v for v in found if exists(self.spark, f"{v}/{MARK}")]

    def materialize(
        self,
        df: DataFrame,
        name: str,
        partition_by: Sequence[str] = (),
        bucket_by: str | None = None,
        buckets: int = BUCKETS,
    ) -> DataFrame:
        """Rebuild the stage, and return it as read back from storage (which also cuts its lineage).

        `df` may read the stage itself. A frame that reads the version before stays valid; older ones are deleted. With
        `bucket_by` the rows are stored in `buckets` files by the hash of that column, sorted by it. Stages with the same
        buckets are then joined, grouped and windowed on the column without a shuffle, as often as they are read.
        """
        if bucket_by and partition_by:
            raise ValueError("a stage is either partitioned or bucketed")
        folder = self.path(name)
        numbers = [int(v.split("-")[1]) for v in names_in(self.spark, folder) if v.startswith("v-")]
        version = f"{folder}/v-{max(numbers, default=0) + 1:09d}-{uuid.uuid4().hex[:8]}"
        if bucket_by:
            # one task for each bucket, else every task would write a file into every bucket
            table = _passing_name()
            rows = df.repartition(buckets, bucket_by).write.format("parquet").option("path", version)
            rows.bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")
            create_empty(self.spark, f"{version}/{BUCKETED}{buckets}-{bucket_by}")
        else:
            df.write.partitionBy(*partition_by).parquet(version)
        create_empty(self.spark, f"{version}/{MARK}")
        for old in self.versions(name)[:-KEPT]:
            delete_folder(self.spark, old)
        return self._frame(version)

    def read(self, name: str) -> DataFrame:
        """The newest published version."""
        found = self.versions(name)
        if not found:
            raise FileNotFoundError(f"stage {name} has not been published under {self.root}")
        return self._frame(found[-1])

    def _frame(self, version: str) -> DataFrame:
        """A version's rows; those of a bucketed one by way of a table that is known while the frame is made."""
        rows = self.spark.read.parquet(version)
        told = [n.removeprefix(BUCKETED).split("-", 1) for n in names_in(self.spark, version) if n.startswith(BUCKETED)]
        if not told:
            return rows
        [(buckets, key)], table = told, _passing_name()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {buckets} BUCKETS LOCATION '{version}'"
        )
        frame = self.spark.table(table)
        frame.schema  # resolved now, so the catalog is not asked again
        self.spark.sql(f"DROP TABLE {table}")
        return frame


def _passing_name() -> str:
    return f"stage_{uuid.uuid4().hex}"
