"""Casts of untrusted keys and measures: a bad value becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StringType,
)

#: Wide enough for partner money with sub-cent digits; sums stay exact and order-independent.
MEASURE_TYPE = "decimal(24,6)"


def int_from_text(text: Column, to: str = "int") -> Column:
    """Whole number from text; ``12.5`` rounds away from zero, ``1e3`` is read, junk is NULL.

    Goes through DECIMAL because a DOUBLE parse would also accept ``12D`` as a number.
    """
    return F.round(text.try_cast("decimal(38,10)"), 0).try_cast(to)


def int_from_double(value: Column, to: str = "int") -> Column:
    """Whole number from a floating value, halves to even."""
    return F.bround(value, 0).try_cast(to)


def int_column(df: DataFrame, name: str, to: str = "int") -> Column:
    """The cast that fits the declared type of ``df[name]``."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return int_from_text(F.col(name), to)
    if isinstance(kind, (DoubleType, FloatType)):
        return int_from_double(F.col(name), to)
    if kind.simpleString() == to:
        return F.col(name)
    return F.col(name).try_cast(to)


def measure_column(df: DataFrame, name: str, to: str = MEASURE_TYPE) -> Column:
    """An exact measure: decimals as they are, anything else as ``to``."""
    if isinstance(df.schema[name].dataType, DecimalType):
        return F.col(name)
    return F.col(name).try_cast(to)


def flag_column(df: DataFrame, name: str) -> Column:
    """A 0/1 flag from whatever the source used: integer, boolean or text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (BooleanType, IntegralType)):
        return F.col(name).cast("int")
    text = F.lower(F.trim(F.col(name).cast("string")))
    return (
        F.when(text.isin("true", "t", "yes"), 1)
        .when(text.isin("false", "f", "no"), 0)
        .otherwise(int_from_text(text))
    )
