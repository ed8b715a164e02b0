"""Reliable checkpoints in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def default_folder(master: str, warehouse: str) -> str:
    """Where nothing is set: a temporary folder in local mode, a folder of the warehouse elsewhere; an error if other machines don't share that."""
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-checkpoint-")
    if warehouse.startswith(("file:", "/")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; the warehouse ({warehouse}) is a folder of the driver's machine")
    return f"{warehouse}/_checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or ``default_folder`` where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or default_folder(sc.master, spark.conf.get("spark.sql.warehouse.dir")))
    return sc.getCheckpointDir()


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of what runs inside go to a folder of their own, which is deleted in the end. Results must be written elsewhere, or read, before."""
    sc, before = spark.sparkContext, shared_dir(spark)
    sc.setCheckpointDir(f"{before}/run-{uuid.uuid4().hex}")
    own = sc.getCheckpointDir()
    try:
        yield own
    finally:
        sc.setCheckpointDir(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(own).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
