"""Partner KPI sheet: strict headers, blank rows, mixed dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import KPI_DATE_COLUMNS, KPI_HEADERS
from ..functions.dates import iso_date_text
from ..schemas import REQUIRED, schema
from .tables import typed


def rename_headers(sheet: DataFrame, headers: Mapping[str, str] = KPI_HEADERS) -> DataFrame:
    """Renames trimmed headers; one that is not in the map fails the load."""
    unknown = [c for c in sheet.columns if c.strip() not in headers]
    if unknown:
        raise ValueError(f"unmapped headers: {unknown}")
    return sheet.toDF(*[headers[c.strip()] for c in sheet.columns])


def drop_blank_rows(sheet: DataFrame) -> DataFrame:
    return sheet.dropna(how="all")


def normalise_kpi(sheet: DataFrame) -> DataFrame:
    """Raw sheet to named text columns with ISO dates, blank rows removed."""
    named = drop_blank_rows(rename_headers(sheet))
    dates = {c: iso_date_text(F.col(c)) for c in KPI_DATE_COLUMNS if c in named.columns}
    return named.withColumns(dates)


def typed_kpi(sheet: DataFrame) -> DataFrame:
    """Normalised sheet in the KPI schema; columns the comparison does not use may be missing."""
    return typed(normalise_kpi(sheet), schema("partner_kpi"), REQUIRED["partner_kpi"])
