"""Typed tables from CSV, Parquet or a database, and replace-loads of them.

CSV is the exchange format, Parquet the format at rest.  A CSV file with quoted line breaks cannot
be split, so each is one task; where no text holds line breaks, ``multi_line=False`` splits them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType, TimestampType

from ..contract import BRAND_CODES, JDBC_FETCH_SIZE, SOURCE_COLUMNS, SOURCE_TABLES
from ..functions.casts import flag_column, int_from_text
from ..functions.dates import day_from_text, window_start
from ..schemas import REQUIRED, schema
from .headers import files_by_header

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def typed(raw: DataFrame, fields: StructType, required: Sequence[str] | None = None) -> DataFrame:
    """Brings text columns to ``fields`` by name; a bad value becomes NULL.

    Columns are found by header, so their order in the file does not matter.  A missing one is an
    error if it is ``required`` (by default all are); any other becomes a column of typed NULLs.
    """
    needed = [f.name for f in fields] if required is None else required
    missing = [name for name in needed if name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for f in fields:
        kind = f.dataType.simpleString()
        if f.name not in raw.columns:
            cell = F.lit(None).cast(f.dataType)
        elif f.name == "voided":
            cell = flag_column(raw, f.name)
        elif isinstance(f.dataType, StringType):
            cell = F.col(f.name)
        elif kind in _INTEGERS and isinstance(raw.schema[f.name].dataType, StringType):
            cell = int_from_text(F.col(f.name), kind)
        elif isinstance(f.dataType, DateType | TimestampType) and isinstance(
            raw.schema[f.name].dataType, StringType
        ):
            cell = F.coalesce(F.col(f.name).try_cast(kind), day_from_text(F.col(f.name)).cast(kind))
        else:
            cell = F.col(f.name).try_cast(kind)
        out.append(cell.alias(f.name))
    return raw.select(*out)


def csv_options(multi_line: bool = True) -> dict[str, str]:
    """Doubled quotes, blanks kept, line breaks inside quotes."""
    return {
        "header": "true",
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def read_text_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """CSV with header as text columns, files with different headers matched by name.

    The reader takes one file's header for all and maps the others by position, so only files
    with the same header are read together.  A column that a file lacks is NULL in its rows.
    """
    groups = files_by_header(spark, path)
    if len(groups) <= 1:
        return spark.read.options(**csv_options(multi_line)).csv(path)
    parts = [spark.read.options(**csv_options(multi_line)).csv(files) for files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(
    spark: SparkSession, path: str | list[str], table: str, multi_line: bool = True
) -> DataFrame:
    """A table from one or more files; each must have the table's required columns."""
    groups = files_by_header(spark, path)
    parts = [
        typed(spark.read.options(**csv_options(multi_line)).csv(files), schema(table), REQUIRED.get(table))
        for files in groups or [path]
    ]
    return reduce(DataFrame.unionByName, parts)


def stub(spark: SparkSession, table: str) -> DataFrame:
    """The table's columns with no rows, so that everything built on it still resolves."""
    return spark.createDataFrame([], schema(table))


def read_optional_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The file, or its stub when there is none."""
    try:
        return read_csv(spark, path, table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return stub(spark, table)


def has_data(df: DataFrame) -> bool:
    """Whether there is a row; a stub exists but has none."""
    return not df.isEmpty()


def rename_source(df: DataFrame, table: str) -> DataFrame:
    """Projects a source table to our column names, in published order."""
    cells = [F.col(f"`{src}`").alias(name) for src, name in SOURCE_COLUMNS[table].items()]
    if table == "fleets":
        cells.insert(2, F.col("FleetID").alias("fleetAccountNumber"))
    return df.select(*cells)


def scoped_select(
    table: str, as_of: date, codes: Sequence[str] = BRAND_CODES, months_back: int = 3
) -> str:
    """The table's scoped rows as the database's own query, so that only these are sent.

    Same rules as ``operators.scope``; to be given to ``jdbc_options`` in place of a table name.
    """
    name = SOURCE_TABLES[table]
    listed = ", ".join("'" + c.replace("'", "''") + "'" for c in codes)
    brand = f"CorpType IN ({listed})"
    recent = (
        f"Invoice_Date >= '{window_start(as_of, months_back)}' AND "
        f"CustomerID IN (SELECT CustomerID FROM {SOURCE_TABLES['customers']} WHERE {brand})"
    )
    billed = f"FROM {SOURCE_TABLES['invoices']} WHERE voided = 0 AND {recent}"
    prefixes = " OR ".join(f"left(Store_Number, {len(c)}) = '" + c.replace("'", "''") + "'" for c in codes)
    where = {
        "customers": brand,
        "sites": prefixes,
        "fleets": f"FleetID IN (SELECT FleetID {billed})",
        "invoices": recent,
        "invoice_item_bridge": f"InvoiceID IN (SELECT InvoiceID {billed})",
    }.get(table)
    return f"(SELECT * FROM {name} WHERE {where}) scoped" if where else name


def jdbc_options(
    url: str, table: str, properties: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Reader options for a source table, or for a select of it."""
    return {
        "url": url,
        "dbtable": SOURCE_TABLES.get(table, table),
        "fetchsize": str(JDBC_FETCH_SIZE),
        **(properties or {}),
    }


def split_query(table: str, column: str, parts: int) -> str:
    """Asks the database where ``parts`` parts of equal size begin, in order of ``column``."""
    source = SOURCE_TABLES.get(table, table)
    return (
        f"(SELECT MIN(k) AS first_key FROM (SELECT {column} AS k, NTILE({parts}) OVER (ORDER BY {column}) AS part "
        f"FROM {source} WHERE {column} IS NOT NULL) tiles GROUP BY part) splits"
    )


def split_predicates(column: str, first_keys: Sequence[object]) -> list[str]:
    """Conditions of the parts: every row meets exactly one, rows without a key the first.

    A key that fills several parts begins one only, so there may be fewer parts than first keys.
    """
    bounds = [
        str(k) if isinstance(k, int | Decimal) else "'" + str(k).replace("'", "''") + "'"
        for k in sorted(set(first_keys))[1:]
    ]
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *inner, f"{column} >= {bounds[-1]}"]


def read_jdbc_split(
    spark: SparkSession, url: str, source: str, table: str, column: str, parts: int, properties: Mapping[str, str]
) -> DataFrame:
    """A source table read by ``parts`` tasks, whose bounds are quantiles that the database gives."""
    asked = jdbc_options(url, split_query(source, column, parts), properties)
    keys = [r[0] for r in spark.read.format("jdbc").options(**asked).load().collect()]
    options = jdbc_options(url, source, properties)
    del options["url"], options["dbtable"]
    rows = spark.read.jdbc(
        url, SOURCE_TABLES.get(source, source), predicates=split_predicates(column, keys), properties=options
    )
    return rename_source(rows, table)


def read_jdbc(spark: SparkSession, options: Mapping[str, str], table: str) -> DataFrame:
    """A source table under our names; later filters and projections reach the database."""
    return rename_source(spark.read.format("jdbc").options(**options).load(), table)
