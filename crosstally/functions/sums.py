"""Exact sums of money."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

CENT = Decimal("0.01")


def exact_sum(df: DataFrame, name: str) -> Column:
    """SUM of ``df[name]`` without rounding, whatever the order of the rows.

    A DECIMAL wide enough for any total is summed as a big number, once per row and level of the
    aggregation.  Amounts in whole cents are therefore summed as BIGINT and scaled afterwards,
    about twice as fast.  A group beyond 9.2e16 currency units is an overflow error (ANSI mode),
    not a wrong number.  Anything finer than a cent keeps the DECIMAL sum.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, DecimalType) or kind.scale > 2:
        return F.sum(name)
    cents = F.sum((F.col(name) * 100).cast("bigint"))
    return (cents.cast("decimal(19,0)") * F.lit(CENT)).cast("decimal(22,2)")
