"""Session helpers: a local session for tests/bench and the shared folder for stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "slotpack") -> SparkSession:
    """Local session configured like a small cluster (AQE on, UI off, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLOTPACK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from the session and never written to it.

    Order: the setting ``spark.checkpoint.dir``, then the folder given to ``setCheckpointDir``. With
    neither, a ``local`` master gets one scratch folder per application (its executors are the driver
    process); any other master raises, because its executors would write to their own disks.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir (or sc.setCheckpointDir) to a folder that the driver and "
                         "all executors share: slotpack stores its intermediate tables there")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="slotpack-")
    return _LOCAL_DIRS[sc.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder; also handed to ``checkpoint()`` where the application has not set one yet."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a stored table of this application in the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables only."""
    return f"{shared_dir(spark)}/slotpack-tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads the files instead of recomputing
    the plan), but stays columnar: later scans prune columns and push filters down.
    """
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the stored tables of this application in the shared folder (call when no result needs them)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
