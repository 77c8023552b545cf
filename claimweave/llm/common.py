"""Helpers that several operators share: shared storage, column hygiene and split rules."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space bytes (what bytes.split() splits on).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    A session that names none gets a temporary folder of this machine in local mode (as in tests), else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: the lineage ends there."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Result columns replace input columns of the same name (compared without case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def id_bucket(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; null and blank texts give none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def give_back() -> None:
    """Memory that nothing uses goes back to the system: a Python worker outlives its tasks, and its free memory would stand beside that of the next ones."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
