"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    The shuffle partition count is left to the cluster (adaptive execution coalesces it); pass
    ``**{"spark.sql.shuffle.partitions": "8"}`` for local runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master, where driver and executors share a disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        local = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", local)
        return local
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str = "stage") -> str:
    """Write ``df`` to a fresh path in the shared folder."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors. Reading a written table also gives
    the optimizer its true size, so a join against it is broadcast when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when it is not.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, label))
