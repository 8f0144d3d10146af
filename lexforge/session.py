"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast by hint; beyond it the planner chooses.
BROADCAST_LIMIT = 8 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set first if nobody has."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lexforge-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint if the optimizer's size estimate is within limit, else df unchanged."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= limit else df


def read_spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row: a scan with fewer splits than cores is dealt out.

    A scan with enough splits is left alone, so large tables are never shuffled for it.
    """
    scan = read(spark, sf_dir, table).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Staged tables of the scopes that are open, the innermost last.
_SCOPES: list[list] = []


@contextmanager
def staging():
    """A scope whose staged tables are deleted at its end: results must have been written or read by then.

    A driver that runs many queries keeps no intermediate table this way.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for fs, at in _SCOPES.pop():
            fs.delete(at, True)


def stage(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner the true size. partition: columns that
    become folders. The folder goes at the end of the scope that ``staging``
    opened, else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append((fs, at))
    return spark.read.schema(df.schema).parquet(path)
