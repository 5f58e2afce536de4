"""Month, product, store-mix and service rollups.

SUM, COUNT, MIN and MAX combine map-side, so a hot key travels as one partial row per task.
The one distinct count is planned by Spark in two steps, first on (keys, id) and then on keys,
which spreads a hot key over its ids.  Months of charges are rolled up where their join with the sites
leaves them; adaptive execution splits a hot site there and shuffles its groups.  The line rollups aggregate on the raw dimension ids before
the dimension joins: sums and counts add up, and the joins then see a few rows per id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import SERVICE_DEFAULT, SERVICE_RULES, SIDES, Sides
from ..functions.dates import month_start
from ..functions.labels import Rules, service_type
from ..functions.sums import exact_sum
from .enrich import SITE_ALONE, SITE_REF, with_fleet, with_site

_MONTH_KEYS = ("period", "fleetCode", "fleetName", "storeNumber", "siteName")


def _per_month(enriched: DataFrame, sides: Sides, *keys: str) -> DataFrame:
    return enriched.groupBy(*keys).agg(
        F.count_distinct("invoiceID").alias("invoiceCount"),
        exact_sum(enriched, "invoiceTotalAmount").alias("totalInvoice"),
        exact_sum(enriched, sides.net_balance).alias(sides.balance),
        exact_sum(enriched, "invoiceTaxTotalAmount").alias("totalTax"),
        exact_sum(enriched, "invoiceTotalDiscounts").alias("totalDiscount"),
        exact_sum(enriched, "invoiceCCFees").alias("totalCcFee"),
        exact_sum(enriched, sides.fee).alias(sides.fee),
        exact_sum(enriched, "totalAiFee").alias("totalAiFee"),
        F.min("invoiceDate").alias("firstInvoiceDate"),
        F.max("invoiceDate").alias("lastInvoiceDate"),
    )


def fleet_store_month(enriched: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """Fleet x store x month; voided invoices are part of it.

    Rows of charges lie by the site they name.  Where no other site has the names of theirs, a group
    has one such site, hence all its rows in one place, and is rolled up there.  Only the others
    (sites that share their names, have none or are missing) are shuffled by the group.
    """
    if SITE_REF not in enriched.columns:
        return _per_month(enriched, sides, *_MONTH_KEYS)
    # Of both sides of the join, so that the optimizer leaves it as it is: either half then reads
    # the same shuffle.
    alone = F.coalesce(F.col(SITE_ALONE) == F.col(SITE_REF), F.lit(False))
    in_place = _per_month(enriched.filter(alone), sides, SITE_REF, *_MONTH_KEYS).drop(SITE_REF)
    return in_place.unionByName(_per_month(enriched.filter(~alone), sides, *_MONTH_KEYS))


def month_order() -> list:
    return [
        F.col("period").desc_nulls_last(),
        *(F.col(k).asc_nulls_last() for k in ("fleetName", "storeNumber", "fleetCode", "siteName")),
    ]


def product_totals(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per product over all lines that have an invoice.

    Fleet and store do not appear in the result, so their joins are left out.
    """
    billed = lines.select(
        "invoiceID", "serviceCatgCode", "itemDescription",
        "serviceActualQuantity", "serviceActualAmount",
    ).join(invoices.select("invoiceID"), "invoiceID")
    return billed.groupBy("serviceCatgCode", "itemDescription").agg(
        F.count(F.lit(1)).alias("lineCount"),
        exact_sum(billed, "serviceActualQuantity").alias("totalQuantity"),
        exact_sum(billed, "serviceActualAmount").alias("totalRevenue"),
    )


def _revenue_and_lines(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        exact_sum(df, "serviceActualAmount").alias("revenue"), F.count(F.lit(1)).alias("lines")
    )


def _combine(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(exact_sum(df, "revenue").alias("revenue"), F.sum("lines").alias("lines"))


def store_product_mix(
    lines: DataFrame, invoices: DataFrame, sites: DataFrame, key_type: str = "int"
) -> DataFrame:
    """Store x category."""
    joined = lines.select("invoiceID", "serviceCatgCode", "serviceActualAmount").join(
        invoices.select("invoiceID", "siteID"), "invoiceID"
    )
    per_site = _revenue_and_lines(joined, "siteID", "serviceCatgCode")
    return _combine(
        with_site(per_site, sites, key_type), "storeNumber", "siteName", "serviceCatgCode"
    )


def service_type_rollup(
    lines: DataFrame,
    invoices: DataFrame,
    fleets: DataFrame,
    sites: DataFrame,
    rules: Rules = SERVICE_RULES,
    default: str = SERVICE_DEFAULT,
    key_type: str = "int",
) -> DataFrame:
    """Month x fleet x store x service bucket."""
    header = invoices.select(
        "invoiceID", month_start(F.col("invoiceDate")).alias("period"), "fleetID", "siteID"
    )
    bucketed = lines.select(
        "invoiceID",
        service_type(F.col("itemDescription"), rules, default).alias("serviceType"),
        "serviceActualAmount",
    )
    per_id = _revenue_and_lines(
        bucketed.join(header, "invoiceID"), "period", "fleetID", "siteID", "serviceType"
    )
    return _combine(
        with_site(with_fleet(per_id, fleets), sites, key_type),
        "period", "fleetCode", "storeNumber", "serviceType",
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one row each."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
