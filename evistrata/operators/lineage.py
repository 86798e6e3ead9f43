"""Cutting lineage through storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a folder of this machine, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evistrata-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of packed rows that one task reads of an exchange: keys of a graph take sixteen times their packed size in memory.
JOINED_BYTES = 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def small_tasks(spark: SparkSession, size: int = JOINED_BYTES) -> None:
    """Let Spark join partitions of an exchange to tasks of ``size`` bytes at most, unless the session asks for less; a setting of the session, as the plans run later."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get(name, "64m").strip().lower())
    if now is None or int(now[1]) * _UNITS[now[2]] > size:
        spark.conf.set(name, f"{size}b")


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
