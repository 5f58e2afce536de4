"""CSV export and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import csv_options


def write_csv(df: DataFrame, path: str) -> int:
    """Writes every row with a header and returns how many there were.

    The count is observed while writing; there is no second pass.
    """
    seen = Observation("csv_rows")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").options(**csv_options()).csv(path)
    return seen.get["rows"]


def shared_directory(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate results.

    The setting is taken at its word: a mounted share looks like a folder of the machine, and a
    path without a scheme is one of the default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once below the shared folder and returns a scan of the written table.

    Consumers then read the table instead of recomputing the plan, and a lost executor costs the
    reread of a file only.
    """
    path = f"{shared_directory(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
