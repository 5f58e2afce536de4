"""Week, month, window and spreadsheet-date expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import SERIAL_EPOCH

#: First and last serial number of a day: 1900-01-01 and 9999-12-31.
SERIAL_DAYS = (2, 2958465)
SATURDAY = 7  # numbering of F.dayofweek: 1 = Sunday .. 7 = Saturday


def week_ending(day: Column, last_day: int = SATURDAY) -> Column:
    """The date that closes the week holding ``day``."""
    d = day.cast("date")
    return F.date_add(d, F.pmod(F.lit(last_day) - F.dayofweek(d), F.lit(7)))


def month_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")


def window_start(as_of: date, months_back: int = 3) -> date:
    """First day of the month ``months_back`` before the month of ``as_of``.

    Returned as a Python date so that the filter it feeds is a plain comparison with a literal,
    which reaches the scan.
    """
    index = as_of.year * 12 + as_of.month - 1 - months_back
    return date(index // 12, index % 12 + 1, 1)


def day_from_text(cell: Column) -> Column:
    """The day of a ``MM/DD/YYYY`` text, else NULL."""
    text = F.trim(cell)
    shaped = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text)
    return F.try_to_timestamp(shaped, F.lit("M/d/yyyy")).cast("date")


def iso_date_text(cell: Column) -> Column:
    """Spreadsheet cell as ``YYYY-MM-DD``: dates and serial numbers are converted, other text kept.

    Serials are those of the years 1900 to 9999; any other number is text.
    """
    text = F.trim(cell.cast("string"))
    number = text.try_cast("decimal(18,6)").try_cast("int")
    serial = F.when(number.between(*SERIAL_DAYS), number)
    from_serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), serial)
    is_iso = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$")
    return (
        F.when(serial.isNotNull(), F.date_format(from_serial, "yyyy-MM-dd"))
        .when(is_iso, F.coalesce(F.date_format(text.try_cast("date"), "yyyy-MM-dd"), cell))
        .otherwise(F.coalesce(F.date_format(day_from_text(text), "yyyy-MM-dd"), cell))
    )


def months_before(day: date, months: int) -> date:
    """The same day ``months`` earlier, or the last day of that month when it is shorter."""
    first = window_start(day, months)
    length = (window_start(first, -1) - first).days
    return first.replace(day=min(day.day, length))
