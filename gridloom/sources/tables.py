"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is several."""
    return master == "local" or master.startswith("local[")


def demand_shared(folder: str, scheme: str, master: str) -> str:
    """``folder``, which on a cluster may not be on a disk that each machine has for itself."""
    if scheme == "file" and not is_local(master):
        raise ValueError(f"{folder} is a folder of one machine: set spark.checkpoint.dir to one that driver and executors share")
    return folder


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the warehouse if it is no machine's own folder, or with a local master a
    temporary folder."""
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not is_local(spark.sparkContext.master):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return demand_shared(folder, where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme(), spark.sparkContext.master)
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="gridloom-"))


def new_folder(spark: SparkSession) -> str:
    """A folder for files of one's own, removed with the intermediate tables."""
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once and read back. What is used several times is computed once, plans stay short, and lost executors cost
    nothing. This runs a job: functions that call it do so while they build their result."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The intermediate tables that are there now."""
    return set(_WRITTEN)


def drop(paths: set[str]) -> None:
    """Removes intermediate tables that no pending result reads any more."""
    for path in paths:
        if spark := _WRITTEN.pop(path, None):
            with contextlib.suppress(Exception):  # the JVM may be gone
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    drop(written())
