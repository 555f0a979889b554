"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new folder on a local master (tests), else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-core-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a new table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
