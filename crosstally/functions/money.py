"""Money expressions on DECIMAL columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import MATCHED, SALES_TAX_RATE, SIDES, TOLERANCE, VARIANCE, Sides

ZERO = Decimal(0)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(ZERO))


def net_balance(total: Column, prepaid: Column) -> Column:
    """What is left to collect; unknown when the total is unknown."""
    return total - or_zero(prepaid)


def cascading_fee(total: Column, flat: Column, own_pct: Column, brand_pct: Column) -> Column:
    """Flat part plus a percentage, the provider's own rate before the brand's."""
    return or_zero(flat) + total * F.coalesce(own_pct, brand_pct, F.lit(ZERO))


def variance(booked: Column, reported: Column) -> Column:
    return or_zero(booked) - or_zero(reported)


def variance_pct(booked: Column, reported: Column) -> Column:
    """Variance relative to the reported amount; NULL unless that amount is positive."""
    base = reported.cast("double")
    return F.when(reported > 0, (or_zero(booked).cast("double") - base) / base)


def recon_status(
    booked: Column, reported: Column, tolerance: Decimal = TOLERANCE, sides: Sides = SIDES
) -> Column:
    """Missing on one side, matched within the tolerance, or a variance.

    A side counts as missing when its *amount* is NULL, so a group whose amounts are all NULL is
    missing too, and with both NULL the booked side is named.
    """
    return (
        F.when(booked.isNull(), sides.missing_booked)
        .when(reported.isNull(), sides.missing_reported)
        .when(F.abs(booked - reported) < F.lit(tolerance), MATCHED)
        .otherwise(VARIANCE)
    )


def line_total(unit_price: Column, quantity: Column) -> Column:
    return F.round(unit_price * quantity, 2)


def sales_tax(subtotal: Column, discount: Column, rate: Decimal = SALES_TAX_RATE) -> Column:
    return F.round((subtotal - discount) * F.lit(rate), 2)


def billed_total(subtotal: Column, discount: Column, tax: Column) -> Column:
    return subtotal - discount + tax
