"""Tables that are written once and read often: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session takes a folder of its own and a cluster its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spotlake-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/spotlake-work")
    return sc.getCheckpointDir().rstrip("/")


def path_of(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spotlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = path_of(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A narrow finite input with fewer splits than cores, dealt to all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df
