"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster operator would put in spark-defaults; shuffle partitions are left to AQE there.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the rendered test rows are small but costly to work on: keep them spread over the cores after a shuffle
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("concord")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor can see: under spark.checkpoint.dir; where that is unset, on one machine, under the
    session's warehouse (tests). Several machines without the setting are an error, as their local folders differ."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return os.path.join(root, name)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Reliable checkpoints go to spark.checkpoint.dir; a folder of our own is set only where that is unset (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark, "checkpoints"))


def new_run_dir(spark: SparkSession) -> str:
    """A folder of its own for the stage tables of one run."""
    return os.path.join(shared_dir(spark, "runs"), uuid.uuid4().hex)


def as_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a stage as a table in the shared folder and read it back.

    Several later stages read it, so it is computed once; the plan is cut, and a lost executor costs a re-read
    instead of a recomputation.
    """
    path = os.path.join(folder, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
