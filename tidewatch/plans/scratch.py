"""Tables written once to the cluster's shared folder, to cut lineage.

A written table survives the loss of any executor, holds column statistics and is read with column
pruning. The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session
without that setting gets a temporary folder of its own; on a cluster without it, the warehouse,
which executors share, is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidewatch-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        return f"file://{_local[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``clear`` removes it with the others."""
    return f"{shared_dir(spark)}/tidewatch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and returns a reader of it; its plan is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of any file system that Spark reaches holds; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; call it when their results have been written."""
    remove(spark, f"{shared_dir(spark)}/tidewatch-{spark.sparkContext.applicationId}")
