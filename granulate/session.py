"""Session helpers: lineage cuts in the shared folder and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


MOVED = 2 << 30  # bytes (as the optimizer estimates them) that are redistributed over idle cores at most


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table `table` of `sf_dir`; a file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, which is read from the session.

    Only a session on one machine (tests) may name none and is given a temporary
    folder; on a cluster a missing folder is an error, as executors share no local disk.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="granulate-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return spark.sparkContext.getCheckpointDir() or known


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint, which outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables under the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores, before per-row Python work.

    Only an input of few files and of at most MOVED bytes is moved; a large one
    has its partitions, and its texts are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= MOVED else df
