"""Reads of the library's tables, and tables written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a session on one machine may go without that setting."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(home or '/tmp/lodestone-checkpoints').rstrip('/')}/lodestone-files/{spark.sparkContext.applicationId}"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; it stays until `clear`."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to shared folders, once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new shared folder and read again: later steps read the same rows, and survive lost executors."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
