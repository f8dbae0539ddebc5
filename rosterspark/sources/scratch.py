"""Tables that a job writes for itself, in a folder that all executors see.

A written table cuts the lineage: a lost executor costs no earlier stage, and a table that
several steps read is computed once. Each application has a folder of its own; its tables
are of use while its DataFrames are, so ``clear`` is for the end of a session or for a
moment when no DataFrame is pending, and ``clear_others`` for what dead applications left.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
PREFIX = "rosterspark-"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; all executors can reach it. A cluster
    must name one: a folder of one machine would lose what others write there."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{PREFIX}{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the application's folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(spark: SparkSession):
    """(file system, status) of the folders of all applications."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(root) if files.exists(root) else []
    return files, [s for s in found if s.getPath().getName().startswith(PREFIX)]


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this application wrote; gives their number."""
    files, found = _folders(spark)
    own = [s for s in found if s.getPath().getName() == PREFIX + spark.sparkContext.applicationId]
    n = sum(len(files.listStatus(s.getPath())) for s in own)
    for s in own:
        files.delete(s.getPath(), True)
    return n


def clear_others(spark: SparkSession, hours: float = 72.0) -> int:
    """Deletes the folders of other applications that nothing was added to for ``hours``;
    gives their number."""
    files, found = _folders(spark)
    old = [s for s in found if s.getPath().getName() != PREFIX + spark.sparkContext.applicationId and s.getModificationTime() < 1000 * (time.time() - 3600 * hours)]
    for s in old:
        files.delete(s.getPath(), True)
    return len(old)
