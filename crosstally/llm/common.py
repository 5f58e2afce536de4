"""What the operators share: tables, intermediate results, words, bindings inside expressions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import remove

#: ASCII white space separates words; Java and RE2 read the class alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, as ``--py-files`` would."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="crosstally-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where it is unset and the master
    is local (tests), a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="crosstally-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a Python worker gets at once; the default, 10,000, may be a gigabyte of long texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of what was written.

    This cuts the lineage so that a lost executor costs a reread, fixes generated row ids, and
    gives Spark the measured size by which it decides on broadcasts.  ``batch`` bounds the rows of
    an Arrow batch while it is written.  The shuffle files behind it are deleted once it is written,
    as they would otherwise stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {CLEANUP: "true"} | ({BATCH: batch} if batch else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        remove(df)


#: Rows of a stored table of a few fixed-width columns that may be broadcast: some 40 MB.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow keys, to be broadcast if it was counted to be small.

    Texts then stay where they are; beyond the bound they are shuffled to meet the keys.
    """
    return F.broadcast(keys) if keys.count() <= rows else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
