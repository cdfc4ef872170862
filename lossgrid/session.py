"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
# Spark's own batches are 10 000 rows whatever their size; the JVM and the Python worker of each task hold whole batches
ARROW_BYTES = 4 << 20


def build_session(app: str = "lossgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; a cluster's own settings win over none of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Point Spark at the shared checkpoint folder the cluster names; `fallback` only counts where none is named."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None) or fallback
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bound_arrow_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Batches of texts that go to Python follow bytes, not only rows; a bound that the session has stays."""
    if spark.conf.get(ARROW_CONF, None) is None:
        spark.conf.set(ARROW_CONF, str(most))


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A whole number that a session may set as `lossgrid.<name>`."""
    return int(spark.conf.get(f"lossgrid.{name}", str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may go without it."""
    local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    own = os.path.join(tempfile.gettempdir(), "lossgrid-checkpoints") if local else None
    folder = use_checkpoint_dir(spark, own)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def _at(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path, for whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder?"""
    fs, at = _at(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies directly in a folder; none if there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def create_empty(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.create(at, False).close()


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, at = _at(spark, folder)
    fs.delete(at, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
