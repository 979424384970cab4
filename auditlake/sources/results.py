"""Result tables of runs: a run of some engagements replaces theirs alone, and a reader sees a run whole or not at all.

A table is a folder. A run writes its rows to a folder of its own, then a manifest: which run each engagement's rows are in.
The manifest of the largest number whose write was ended is in force, so a run that fails on the way changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

E, RUN = "engagement_id", "_run"


def _version(spark: SparkSession, path: str) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return -1
    names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{n}/_SUCCESS"))]
    return max(done, default=-1)


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A row an engagement: engagement_id and its run (null for a first run)."""
    return spark.read.parquet(f"{path}/_manifest/v={version}")


def replace_results(df: DataFrame, path: str, engagements: DataFrame | None = None, by: tuple[str, ...] = (E, "rule_code")) -> str:
    """Write a run's rows and put them in the place of all that its engagements had; the other engagements' files are neither
    read nor written. engagements: those that the run was about, also such without rows now; else those of df. Returns the
    run's name. Of two writers at once the later one fails."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{path}/{RUN}={run}")
    about = (engagements or spark.read.schema(df.schema).parquet(f"{path}/{RUN}={run}")).select(E).distinct().withColumn(RUN, F.lit(run))
    version = _version(spark, path)
    if version >= 0:
        old = _manifest(spark, path, version)
        about = old.join(about.select(E), E, "left_anti").unionByName(about)
    about.coalesce(1).write.mode("error" if not _leftover(spark, path, version + 1) else "overwrite").parquet(f"{path}/_manifest/v={version + 1}")
    return run


def _leftover(spark: SparkSession, path: str, version: int) -> bool:
    """Whether a manifest of that number was begun by a run that didn't end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/v={version}")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(root) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/v={version}/_SUCCESS"))


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows in force, of the runs that the manifest names."""
    version = _version(spark, path)
    if version < 0:
        return spark.createDataFrame([], schema)
    manifest = _manifest(spark, path, version)
    runs = [r[0] for r in manifest.select(RUN).distinct().collect()]  # one for each run with rows in force
    kept = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField(RUN, T.StringType())])
    every = spark.read.schema(kept).option("basePath", path).parquet(*(f"{path}/{RUN}={r}" for r in runs))
    return every.join(manifest, [E, RUN], "left_semi").drop(RUN)
