"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark opens the path itself, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few splits dealt out to all cores, for work that is heavy for its bytes; larger ones stay as they are.

    Only a table of fewer splits than cores is shuffled, so what is shuffled is small whatever the cluster reads. ``scan``
    is a table as read, with its columns selected: its splits are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, for clusters that do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quirelane_shipped", False):
        return
    sc._quirelane_shipped = True
    if _PACKAGE.suffix == ".zip" or not _PACKAGE.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quirelane-"), "quirelane.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(target)


def shared_top(spark: SparkSession) -> str:
    """The folder that the session names for all executors: its checkpoint folder.

    Where none is named, a local session (as in tests) gets a temporary one of this machine; a cluster's executors
    wouldn't find each other's files there, so that is an error.
    """
    sc = spark.sparkContext
    if named := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quirelane-shared-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one use below ``shared_top``."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage with a reliable checkpoint in ``shared_top``; executors can be lost afterwards."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint(eager=True)
