"""File-level reading: listing, routing by name, latest file, whole documents."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import DOCUMENT_EXTENSIONS, FILE_ROLES
from ..functions.labels import first_rule
from .tables import read_csv


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def filled_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, file_name) of the matching files that hold a byte; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return listed.select("path", base_name(F.col("path")).alias("file_name"))


def empty_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, file_name) of the matching files without a byte.

    Spark's scans pass over them, but the listing behind a scan has them; it is asked for its
    names once, as a whole.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    names = spark.createDataFrame([(unquote(p),) for p in listed.inputFiles()], "path STRING")
    found = names.withColumn("file_name", base_name(F.col("path")))
    return found.join(filled_files(spark, directory, pattern).select("file_name"), "file_name", "left_anti").select(
        "path", "file_name"
    )


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, file_name) of the matching files, those of zero bytes included; contents are not read."""
    return filled_files(spark, directory, pattern).union(empty_files(spark, directory, pattern))


def file_role(file_name: Column) -> Column:
    """Target table named by the file name; the first matching word decides, else NULL."""
    return first_rule(file_name, FILE_ROLES, None)


def routed_paths(spark: SparkSession, directory: str) -> dict[str, list[str]]:
    """Paths per target table, one row of names per table; the folder is listed once."""
    files = filled_files(spark, directory, "*.csv").select("path", file_role(F.col("file_name")).alias("role"))
    roles = files.filter("role IS NOT NULL").groupBy("role").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {r["role"]: r["paths"] for r in roles.collect()}


def read_routed(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Every routed file of a drop folder, one table per role."""
    return {
        role: read_csv(spark, paths, role) for role, paths in routed_paths(spark, directory).items()
    }


def latest_file(spark: SparkSession, directory: str, pattern: str = "*.csv") -> str:
    """Path of the file with the greatest name."""
    newest = list_files(spark, directory, pattern).agg(F.max_by("path", "file_name")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    return newest


def read_documents(
    spark: SparkSession, directory: str, pattern: str = f"*{DOCUMENT_EXTENSIONS[0]}"
) -> DataFrame:
    """(file_name, text): one row per file, the whole text in one value, empty for an empty file."""
    files = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True)
    none = empty_files(spark, directory, pattern).select("file_name", F.lit("").alias("text"))
    return files.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    ).union(none)
