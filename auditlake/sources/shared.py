"""Tables that a job writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder under the warehouse; with a warning where that is local to a machine of many."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset and the warehouse is a local path: executors must share it", stacklevel=2)
    return f"{warehouse}/_shared"


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later reads see the same rows and don't recompute them, also after an
    executor is lost. The folder goes when the application ends."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)
