"""Tables at rest: whole versions behind one pointer, facts laid out for their joins and windows.

A load writes a new version beside the old one and then moves the pointer, a small file, in one
rename.  Readers see the old tables or the new ones; a load that fails leaves the old ones, and a
load may read what it replaces.  The version before stays until the next load, for those who read.
One load at a time.

Invoices and their lines are bucketed and sorted by the invoice's id, so their join has no shuffle.
Invoices are cut by month besides: a window or date filter then reads its months only.  Spark keeps
buckets in its catalog and not with the files, so reading enters the tables there again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import month_start
from ..operators.scope import MONTH

POINTER = "current"


@dataclass(frozen=True)
class Layout:
    """Column that a table is bucketed by, and the one whose month cuts it."""

    key: str
    day: str | None = None


LAYOUTS = {"invoices": Layout("invoiceID", "invoiceDate"), "invoice_item_bridge": Layout("invoiceID")}


def _catalog_name(version: str, table: str) -> str:
    return f"rest_{version.removeprefix('v-')}_{table}"


def _write_bucketed(df: DataFrame, layout: Layout, buckets: int, name: str, path: str) -> None:
    if layout.day:
        df = df.withColumn(MONTH, month_start(F.col(layout.day)))
    # A task holds whole buckets, so a bucket is one file (a month).
    writer = df.repartition(buckets, layout.key).write.format("parquet").option("path", path)
    if layout.day:
        writer = writer.partitionBy(MONTH)
    writer.bucketBy(buckets, layout.key).sortBy(layout.key).saveAsTable(name)


def pointer(spark: SparkSession, directory: str) -> dict | None:
    """What the pointer says; nothing where there is none."""
    try:
        return json.loads(spark.read.text(f"{directory}/{POINTER}", wholetext=True).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _point(spark: SparkSession, directory: str, content: dict) -> None:
    """Replaces the pointer; the rename is atomic where the file system's is."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(directory, POINTER), hadoop.Path(directory, f"_{POINTER}-{uuid.uuid4().hex}")
    stream = new.getFileSystem(conf).create(new, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(old.getFileSystem(conf).getUri(), conf)
    qualified = [p.getFileSystem(conf).makeQualified(p) for p in (new, old)]
    context.rename(*qualified, options)


def _drop_others(spark: SparkSession, directory: str, kept: set[str]) -> None:
    """Deletes versions that no pointer names, those of failed loads included."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    glob = hadoop.Path(directory, "v-*")
    system = glob.getFileSystem(conf)
    for status in system.globStatus(glob) or []:
        version = status.getPath().getName()
        if version not in kept:
            for table in LAYOUTS:
                spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(version, table)}")
            system.delete(status.getPath(), True)


def replace_tables(frames: Mapping[str, DataFrame], directory: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """Writes a version of the tables, points to it and returns scans of it.

    With ``buckets`` the facts are laid out by ``LAYOUTS``; choose about their size divided by
    what a task should hold, the same at every load.
    """
    spark = next(iter(frames.values())).sparkSession
    before, version = pointer(spark, directory), f"v-{uuid.uuid4().hex}"
    for name, df in frames.items():
        path, layout = f"{directory}/{version}/{name}", LAYOUTS.get(name)
        if buckets and layout:
            _write_bucketed(df.drop(MONTH), layout, buckets, _catalog_name(version, name), path)
        else:
            df.drop(MONTH).write.parquet(path)
    schemas = {name: df.drop(MONTH).schema.jsonValue() for name, df in frames.items()}
    _point(spark, directory, {"version": version, "buckets": buckets, "tables": schemas})
    _drop_others(spark, directory, {version} | ({before["version"]} if before else set()))
    return read_tables(spark, directory)


def _enter(spark: SparkSession, name: str, path: str, schema: StructType, layout: Layout, buckets: int) -> DataFrame:
    """A bucketed table under a name of its version."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by_month = f"PARTITIONED BY ({MONTH})" if layout.day else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}{f', {MONTH} date' if layout.day else ''}) USING parquet "
        f"{by_month} CLUSTERED BY (`{layout.key}`) SORTED BY (`{layout.key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if layout.day:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def read_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables of the version that the pointer names."""
    found = pointer(spark, directory)
    if found is None:
        raise FileNotFoundError(f"no tables at rest in {directory}")
    frames = {}
    for name, fields in found["tables"].items():
        path, layout = f"{directory}/{found['version']}/{name}", LAYOUTS.get(name)
        schema = StructType.fromJson(fields)
        if found["buckets"] and layout:
            own = _catalog_name(found["version"], name)
            frames[name] = _enter(spark, own, path, schema, layout, found["buckets"])
        else:
            frames[name] = spark.read.schema(schema).parquet(path)
    return frames
