"""Scoping of raw tables to a brand list and a rolling month window.

Date bounds are literals compared with the bare column and code lists are plain ``IN``
predicates, so both are pushed into Parquet and JDBC scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import BRAND_CODES
from ..functions.dates import window_start


#: First day of the month, which invoices at rest are cut by; other invoices do not have it.
MONTH = "invoiceMonth"


def not_voided_strict(voided: Column) -> Column:
    """Extract rule: an unknown flag is dropped."""
    return voided == 0


def not_voided_lenient(voided: Column) -> Column:
    """Reconciliation rule: an unknown flag is kept.  Spelled so that it reaches the scan."""
    return voided.isNull() | (voided == 0)


def in_window(day: Column, as_of: date, months_back: int = 3) -> Column:
    """On or after the first day of the month ``months_back`` before ``as_of``; no upper bound."""
    return day >= F.lit(window_start(as_of, months_back))


def scope_customers(customers: DataFrame, codes: Sequence[str] = BRAND_CODES) -> DataFrame:
    return customers.filter(F.col("corpType").isin(list(codes)))


def scope_sites(sites: DataFrame, prefixes: Sequence[str] = BRAND_CODES) -> DataFrame:
    """Sites by store-code prefix, without touching the invoices."""
    tests = [F.col("storeNumber").startswith(p) for p in prefixes]
    return sites.filter(reduce(lambda a, b: a | b, tests))


def _provider_keys(customers: DataFrame, codes: Sequence[str]) -> DataFrame:
    return scope_customers(customers, codes).select("customerID")


def scope_invoices(
    invoices: DataFrame,
    customers: DataFrame,
    as_of: date,
    codes: Sequence[str] = BRAND_CODES,
    months_back: int = 3,
) -> DataFrame:
    """Invoices of the scoped providers inside the window; voided ones stay in."""
    recent = invoices.filter(in_window(F.col("invoiceDate"), as_of, months_back))
    if MONTH in invoices.columns:
        recent = recent.filter(F.col(MONTH) >= F.lit(window_start(as_of, months_back)))
    return recent.join(_provider_keys(customers, codes), "customerID").select(invoices.columns)


def scope_lines(
    lines: DataFrame,
    invoices: DataFrame,
    customers: DataFrame,
    as_of: date,
    codes: Sequence[str] = BRAND_CODES,
    months_back: int = 3,
) -> DataFrame:
    """Line items of the scoped, not voided invoices.

    """
    return lines_of(lines, scope_invoices(invoices, customers, as_of, codes, months_back))


def lines_of(lines: DataFrame, scoped: DataFrame) -> DataFrame:
    """Line items of invoices that are scoped already, but for voided ones.

    The invoices are narrowed to one key column before they meet the lines, so the big join
    moves ids on that side only.
    """
    keys = scoped.filter(not_voided_strict(F.col("voided"))).select("invoiceID")
    return lines.join(keys, "invoiceID").select(lines.columns)


def scope_fleets(
    fleets: DataFrame,
    invoices: DataFrame,
    customers: DataFrame,
    as_of: date,
    codes: Sequence[str] = BRAND_CODES,
    months_back: int = 3,
) -> DataFrame:
    """Fleets with at least one scoped, not voided invoice."""
    return fleets_of(fleets, scope_invoices(invoices, customers, as_of, codes, months_back))


def fleets_of(fleets: DataFrame, scoped: DataFrame) -> DataFrame:
    """Fleets of invoices that are scoped already, but for voided ones.

    The key set is made distinct first: its map-side half collapses a fleet that owns a large
    share of the invoices before anything is shuffled.
    """
    keys = scoped.filter(not_voided_strict(F.col("voided"))).select("fleetID").distinct()
    return fleets.join(keys, "fleetID", "left_semi").select(fleets.columns)
