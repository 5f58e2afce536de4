"""Full-outer comparison of two parties' amounts, and the reports on top of it.

Both sides are first reduced to one row per key.  That makes the join free of hot keys by
construction (every key tuple occurs at most once per side, and rows with a NULL in one key are
still spread by the other two) and lets it reuse the partitioning of the two aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import (
    DISPLAY_ROWS,
    SIDES,
    TOLERANCE,
    TOP_VARIANCES,
    UNKNOWN_NAME,
    VARIANCE,
    Sides,
)
from ..functions import money
from ..functions.casts import int_column, measure_column
from ..functions.sums import exact_sum
from .enrich import with_week

KEYS = ("weekEnding", "fleetAccountNumber", "storeNumber")


def reconcile(
    booked: DataFrame,
    reported: DataFrame,
    keys: Sequence[str],
    booked_measures: Sequence[str],
    reported_measures: Sequence[str],
    amounts: tuple[str, str],
    identity: Mapping[str, Sequence[str]] | None = None,
    tolerance: Decimal = TOLERANCE,
    sides: Sides = SIDES,
) -> DataFrame:
    """Compare two tables that hold one row per key tuple.

    ``amounts`` names the booked and the reported measure to compare.  ``identity`` lists, per
    output name column, the places to look it up (``"booked.x"`` / ``"reported.y"``).
    A NULL in a key matches nothing, so such rows come out as one-sided rows.
    """
    b, r = booked.alias("booked"), reported.alias("reported")
    same = reduce(lambda x, y: x & y, [F.col(f"booked.{k}") == F.col(f"reported.{k}") for k in keys])
    left, right = F.col(f"booked.{amounts[0]}"), F.col(f"reported.{amounts[1]}")
    filled = [F.coalesce(F.col(f"booked.{k}"), F.col(f"reported.{k}")).alias(k) for k in keys]
    named = [
        F.coalesce(*[F.col(p) for p in places], F.lit(UNKNOWN_NAME)).alias(name)
        for name, places in (identity or {}).items()
    ]
    return b.join(r, same, "full_outer").select(
        *filled,
        *named,
        *[F.col(f"booked.{m}") for m in booked_measures],
        *[F.col(f"reported.{m}") for m in reported_measures],
        money.variance(left, right).alias("variance"),
        money.variance_pct(left, right).alias("variancePct"),
        money.recon_status(left, right, tolerance, sides).alias("reconStatus"),
    )


def booked_week(core: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """Booked side at week x fleet x store; apply the voided rule and any filter before."""
    return with_week(core).groupBy(*KEYS).agg(
        F.max("fleetName").alias("fleetName"),
        F.max("siteName").alias("siteName"),
        F.count_distinct("invoiceID").alias(sides.invoice_count),
        exact_sum(core, "invoiceTotalAmount").alias(sides.total_invoice),
        exact_sum(core, sides.net_balance).alias(sides.balance),
        exact_sum(core, "invoiceTotalDiscounts").alias(sides.discount),
    )


def reported_rows(kpi: DataFrame, key_type: str = "int") -> DataFrame:
    """KPI rows with keys and measures cast; whatever fails to cast becomes NULL."""
    return kpi.select(
        F.col("weekEnding").try_cast("date").alias("weekEnding"),
        int_column(kpi, "fleetAccountNumber", key_type).alias("fleetAccountNumber"),
        int_column(kpi, "storeNumber", key_type).alias("storeNumber"),
        "fleetAccountName",
        measure_column(kpi, "grossSales").alias("grossSales"),
        measure_column(kpi, "discountsDollars").alias("discountsDollars"),
        int_column(kpi, "carsPerDay").alias("carsPerDay"),
        int_column(kpi, "oilChanges").alias("oilChanges"),
    )


def reported_week(rows: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """Reported side at week x fleet x store."""
    return rows.groupBy(*KEYS).agg(
        F.max("fleetAccountName").alias("fleetAccountName"),
        exact_sum(rows, "grossSales").alias(sides.gross),
        exact_sum(rows, "discountsDollars").alias(sides.reported_discounts),
        F.sum("carsPerDay").alias(sides.cars_per_day),
        F.sum("oilChanges").alias(sides.oil_changes),
    )


def variance_fleet_store_week(
    core: DataFrame,
    reported: DataFrame,
    tolerance: Decimal = TOLERANCE,
    sides: Sides = SIDES,
) -> DataFrame:
    """Weekly variance from filtered enriched invoices and cast KPI rows."""
    return reconcile(
        booked_week(core, sides),
        reported_week(reported, sides),
        KEYS,
        (sides.invoice_count, sides.total_invoice, sides.balance, sides.discount),
        (sides.gross, sides.reported_discounts, sides.cars_per_day, sides.oil_changes),
        (sides.balance, sides.gross),
        {
            "fleetName": ("booked.fleetName", "reported.fleetAccountName"),
            "siteName": ("booked.siteName",),
        },
        tolerance,
        sides,
    )


def with_status(weekly: DataFrame, status: str = "all") -> DataFrame:
    """Rows of one status; summaries are meant to be taken before this filter."""
    return weekly if status == "all" else weekly.filter(F.col("reconStatus") == status)


def variance_summary(weekly: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """One row per status that occurs."""
    return weekly.groupBy("reconStatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce(F.col(sides.invoice_count), F.lit(0))).alias(f"{sides.booked}Invoices"),
        F.sum(money.or_zero(F.col(sides.balance))).alias(f"{sides.booked}Total"),
        F.sum(money.or_zero(F.col(sides.gross))).alias(f"{sides.reported}Total"),
        F.sum(money.or_zero(F.col("variance"))).alias("netVariance"),
    )


def _abs_variance() -> Column:
    return F.abs(F.col("variance"))


def _tie_break() -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in (*KEYS, "fleetName", "siteName")]


def top_variances(weekly: DataFrame, n: int = TOP_VARIANCES) -> DataFrame:
    """The ``n`` largest absolute variances, ties in key order; each task keeps only ``n`` rows."""
    return with_status(weekly, VARIANCE).orderBy(_abs_variance().desc(), *_tie_break()).limit(n)


def _drill_down(weekly: DataFrame, keys: Sequence[str], touched: str) -> DataFrame:
    """Variance rows per dimension.

    A row of status ``variance`` has both sides, so its three keys are set and occur once.  The
    distinct (week, other key) pairs of a dimension value are therefore its rows, and a plain
    count needs no second shuffle.
    """
    return with_status(weekly, VARIANCE).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(touched),
        F.sum("variance").alias("netVariance"),
        F.sum(_abs_variance()).alias("absVariance"),
    )


def variance_by_store(weekly: DataFrame) -> DataFrame:
    return _drill_down(weekly, ("storeNumber", "siteName"), "fleetWeeksTouched")


def variance_by_fleet(weekly: DataFrame) -> DataFrame:
    return _drill_down(weekly, ("fleetAccountNumber", "fleetName"), "storeWeeksTouched")


def totals_row(weekly: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """One row over the whole filtered set; a ratio does not add up, so the percent stays NULL."""
    return weekly.agg(
        F.sum(sides.invoice_count).alias(sides.invoice_count),
        F.sum(sides.balance).alias(sides.balance),
        F.sum(sides.gross).alias(sides.gross),
        F.sum("variance").alias("variance"),
        F.sum(sides.cars_per_day).alias(sides.cars_per_day),
        F.lit(None).cast("double").alias("variancePct"),
    )


#: What a row of ``report_sets`` is a sum over.
SETS = ("summary", "by_store", "by_fleet", "totals")


def report_sets(weekly: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """Summary, both drill-downs and the totals in one aggregation over GROUPING SETS.

    ``set`` names the output a row belongs to; the columns of the others are NULL or not meant.
    """
    sets = [["reconStatus"], ["storeNumber", "siteName"], ["fleetAccountNumber", "fleetName"], []]
    columns = sets[0] + sets[1] + sets[2]
    differs = F.col("reconStatus") == VARIANCE
    # Bits of the grouping id, first column first; a set bit is a column that is summed over.
    ids = [sum(2 ** (4 - columns.index(c)) for c in columns if c not in one) for one in sets]
    name = F.when(F.grouping_id() == ids[0], SETS[0])
    for k, label in zip(ids[1:], SETS[1:], strict=True):
        name = name.when(F.grouping_id() == k, label)
    return weekly.groupingSets(sets, *columns).agg(
        name.alias("set"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(differs).alias("varianceRows"),
        F.sum(sides.invoice_count).alias(sides.invoice_count),
        F.sum(sides.balance).alias(sides.balance),
        F.sum(sides.gross).alias(sides.gross),
        F.sum("variance").alias("variance"),
        F.sum(sides.cars_per_day).alias(sides.cars_per_day),
        F.sum(F.when(differs, F.col("variance"))).alias("netVariance"),
        F.sum(F.when(differs, _abs_variance())).alias("absVariance"),
    )


def report_outputs(sets: DataFrame, sides: Sides = SIDES) -> dict[str, DataFrame]:
    """The outputs of ``report_sets``, equal to those that are computed one by one."""

    def of(name: str) -> DataFrame:
        return sets.filter(F.col("set") == name)

    def drill_down(name: str, keys: Sequence[str], touched: str) -> DataFrame:
        found = of(name).filter("varianceRows > 0")
        return found.select(*keys, F.col("varianceRows").alias(touched), "netVariance", "absVariance")

    # Nothing is summed over no rows, while the totals are a row then too.
    total = sets.sparkSession.range(1).join(of("totals"), F.lit(True), "left")
    return {
        "summary": of("summary").select(
            "reconStatus",
            "rows",
            F.coalesce(sides.invoice_count, F.lit(0)).alias(f"{sides.booked}Invoices"),
            money.or_zero(F.col(sides.balance)).alias(f"{sides.booked}Total"),
            money.or_zero(F.col(sides.gross)).alias(f"{sides.reported}Total"),
            money.or_zero(F.col("variance")).alias("netVariance"),
        ),
        "totals": total.select(
            sides.invoice_count, sides.balance, sides.gross, "variance", sides.cars_per_day,
            F.lit(None).cast("double").alias("variancePct"),
        ),
        "by_store": drill_down("by_store", ("storeNumber", "siteName"), "fleetWeeksTouched"),
        "by_fleet": drill_down("by_fleet", ("fleetAccountNumber", "fleetName"), "storeWeeksTouched"),
    }


def sort_columns(sort: str, sides: Sides = SIDES) -> list[Column]:
    """Sort choices of the report: largest first, ties in key order."""
    choices = {
        "absVariance": _abs_variance(),
        "variance": F.col("variance"),
        f"{sides.booked}Total": F.col(sides.balance),
        f"{sides.reported}Gross": F.col(sides.gross),
        "weekEnding": F.col("weekEnding"),
    }
    if sort not in choices:
        raise ValueError(f"unknown sort {sort!r}; one of {sorted(choices)}")
    return [choices[sort].desc_nulls_last(), *_tie_break()]


def display_page(
    weekly: DataFrame, sort: str = "absVariance", rows: int = DISPLAY_ROWS, sides: Sides = SIDES
) -> DataFrame:
    """First page in the chosen order; exports take the whole frame instead."""
    return weekly.orderBy(*sort_columns(sort, sides)).limit(rows)
