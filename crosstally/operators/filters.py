"""Report filters, applied to each side before it is aggregated.

The sides carry different attributes, so a filter can reach one side only: region, district,
voided mode and search narrow the booked side alone.  Rows the booked side loses that way turn
up as missing on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scope import MONTH, not_voided_lenient

#: What a search looks at, and the flags of dimension rows that were searched before the joins.
FLEET_TEXTS, SITE_TEXTS = ("fleetAccountNumber", "fleetName"), ("storeNumber", "siteName")
FLEET_HIT, SITE_HIT = "_fleetHit", "_siteHit"
VOIDED_MODES = ("exclude", "include", "only")


def between_days(day: Column, start: date | None, end: date | None) -> list[Column]:
    """Inclusive day range as comparisons with the bare column, for DATE and TIMESTAMP alike."""
    tests = []
    if start is not None:
        tests.append(day >= F.lit(start))
    if end is not None:
        tests.append(day < F.lit(end + timedelta(days=1)))
    return tests


def months_between(df: DataFrame, start: date | None, end: date | None) -> list[Column]:
    """The same range by the months that invoices at rest are cut by, where they are."""
    if MONTH not in df.columns:
        return []
    bounds = [F.col(MONTH) >= F.lit(start.replace(day=1))] if start is not None else []
    return bounds + ([F.col(MONTH) <= F.lit(end.replace(day=1))] if end is not None else [])


def voided_mode(voided: Column, mode: str) -> list[Column]:
    if mode not in VOIDED_MODES:
        raise ValueError(f"unknown voided mode {mode!r}; one of {VOIDED_MODES}")
    if mode == "include":
        return []
    kept = not_voided_lenient(voided)
    return [kept if mode == "exclude" else ~kept]


def matches_search(needle: str, *columns: str) -> Column:
    """Case-insensitive substring of any of the columns."""
    low = needle.lower()
    hits = [
        F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False)) for c in columns
    ]
    return reduce(lambda a, b: a | b, hits)


def keep(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


@dataclass(frozen=True)
class FilterBar:
    start: date | None = None
    end: date | None = None
    fleet: int | None = None
    store: int | None = None
    region: str | None = None
    district: str | None = None
    voided: str = "exclude"
    search: str | None = None

    def _shared(self) -> list[Column]:
        tests = []
        if self.fleet is not None:
            tests.append(F.col("fleetAccountNumber") == self.fleet)
        if self.store is not None:
            tests.append(F.col("storeNumber") == self.store)
        return tests

    def booked(self, core: DataFrame) -> DataFrame:
        tests = between_days(F.col("invoiceDate"), self.start, self.end)
        tests += months_between(core, self.start, self.end)
        tests += voided_mode(F.col("voided"), self.voided)
        tests += self._shared()
        if self.region is not None:
            tests.append(F.col("region") == self.region)
        if self.district is not None:
            tests.append(F.col("district") == self.district)
        if self.search and FLEET_HIT in core.columns:
            tests.append(F.coalesce(FLEET_HIT, F.lit(False)) | F.coalesce(SITE_HIT, F.lit(False)))
        elif self.search:
            tests.append(matches_search(self.search, *FLEET_TEXTS, *SITE_TEXTS))
        return keep(core, tests)

    def reported(self, rows: DataFrame) -> DataFrame:
        return keep(rows, between_days(F.col("weekEnding"), self.start, self.end) + self._shared())
