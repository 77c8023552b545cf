"""Tables written once below spark.checkpoint.dir, the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (application, name, files) -> folder of a table written by this process.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir.

    A session without one gets a temporary folder of this machine in local mode (as in tests), else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, folder: str) -> str:
    """The names, sizes and times of the files of a folder's tables, as one digest."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "length", "modificationTime")
    return str(listed.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first())


def written_once(spark: SparkSession, name: str, stamp: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table build() gives, written at the first call of this application with this name and stamp and read from then on.

    The stamp stands for what build() reads, as files_of() does for a folder: when it changes the table is built anew.
    """
    key = (spark.sparkContext.applicationId, name, stamp)
    if key not in _WRITTEN:
        path = shared_dir(spark, "table")
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
