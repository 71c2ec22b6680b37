"""Tables in the folder that the driver and all executors share: intermediate results that end a lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a temporary one, for sessions of one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_nearpath_shared", None) or tempfile.mkdtemp(prefix="nearpath-")
        spark.sparkContext._nearpath_shared = named
    return named.rstrip("/")


def intermediate(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted for ``sweep``."""
    path = f"{shared_dir(spark)}/nearpath/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._nearpath_paths = [*noted(spark), path]
    return path


def noted(spark: SparkSession) -> list[str]:
    return getattr(spark.sparkContext, "_nearpath_paths", [])


def sweep(spark: SparkSession, before: int = 0) -> None:
    """Delete the intermediate tables noted after the first ``before``; for when the results that read
    them lazily are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in noted(spark)[before:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    spark.sparkContext._nearpath_paths = noted(spark)[:before]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = intermediate(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no frame needs any more; Spark drops them as its driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
