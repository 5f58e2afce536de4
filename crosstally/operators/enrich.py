"""Left-outer star around the invoice fact.

The star is split by what the consumer needs: an unused left join cannot be dropped by the
optimizer, because it might multiply rows.  The joins are not hinted, but for one: dimensions that
the size statistics prove small are broadcast by Spark, larger ones become sort-merge joins whose
hot keys adaptive execution splits.

Rows that are to be rolled up come as headers and charges.  Fleets meet the headers, and the charges
travel twice: to their header, and to their site, where the rollup finds them side by side.  That
last join is a merge join whatever the size of the sites, as the rollup would else shuffle by itself,
and wider rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import SIDES, Sides
from ..functions import keys, money
from ..functions.dates import month_start, week_ending
from .filters import FLEET_HIT, FLEET_TEXTS, SITE_HIT, SITE_TEXTS, matches_search

_FLEET = ("fleetID", "fleetCode", "fleetAccountNumber", "fleetName")
_SITE = ("siteID", "storeNumber", "siteName", "region", "district", "division")
_CUSTOMER = ("customerID", "customerName", "corpType")

#: Beside the published columns of rows made of charges: the site that the charge names, and the same
#: where no other site has its store number and name.
SITE_REF, SITE_ALONE = "_siteRef", "_siteAlone"


@dataclass(frozen=True)
class Charges:
    """Rows with the ``invoiceID`` of their header and, in column ``site``, the id of their site.

    ``measures`` are SQL over the columns of the rows, level by level, and give the provider's id and the
    amounts of an invoice.  They are computed behind the joins, so that the shuffles carry only what
    they are made of.
    """

    rows: DataFrame
    site: str
    measures: Sequence[Mapping[str, str]]


def _fleet_attributes(fleets: DataFrame) -> DataFrame:
    return fleets.select(
        "fleetID", "fleetCode", "fleetAccountNumber", F.col("fleetAccountName").alias("fleetName")
    )


def _site_attributes(sites: DataFrame, key_type: str) -> DataFrame:
    """Store numbers are parsed here, once per site instead of once per invoice."""
    return sites.select(
        "siteID",
        keys.store_number(F.col("storeNumber"), to=key_type).alias("storeNumber"),
        "siteName", "region", "district", "division",
    )


def _attach(fact: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; the key comes from the dimension, so a miss shows as NULL."""
    raw = f"_{key}"
    fact = fact.withColumnRenamed(key, raw)
    return fact.join(attributes, F.col(raw) == F.col(key), "left").drop(raw)


def with_fleet(invoices: DataFrame, fleets: DataFrame) -> DataFrame:
    return _attach(invoices, _fleet_attributes(fleets), "fleetID")


def with_site(invoices: DataFrame, sites: DataFrame, key_type: str = "int") -> DataFrame:
    return _attach(invoices, _site_attributes(sites, key_type), "siteID")


def with_measures(invoices: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """Period, balance and single-column fee: everything the invoice row alone decides."""
    return invoices.withColumns(
        {
            "period": month_start(F.col("invoiceDate")),
            sides.net_balance: money.net_balance(
                F.col("invoiceTotalAmount"), F.col("prepaidTotalAmount")
            ),
            sides.fee: money.or_zero(F.col("invoiceInvoiceFee")),
        }
    )


def enrich_core(
    invoices: DataFrame,
    fleets: DataFrame,
    sites: DataFrame,
    key_type: str = "int",
    sides: Sides = SIDES,
    search: str | None = None,
) -> DataFrame:
    """Invoices with fleet and store context: what the variance and line paths need.

    ``search`` adds flags for ``FilterBar``: texts are searched once per fleet and site, not per
    invoice.
    """
    fleet, site = _fleet_attributes(fleets), _site_attributes(sites, key_type)
    if search:
        fleet = fleet.withColumn(FLEET_HIT, matches_search(search, *FLEET_TEXTS))
        site = site.withColumn(SITE_HIT, matches_search(search, *SITE_TEXTS))
    return _attach(_attach(with_measures(invoices, sides), fleet, "fleetID"), site, "siteID")


def _alone(sites: DataFrame) -> DataFrame:
    """Marks the sites whose store number and name no other row has; a NULL in them is no name."""
    names = ("storeNumber", "siteName")
    once = (
        sites.dropna(subset=list(names))
        .groupBy(*names)
        .agg(F.min("siteID").alias(SITE_ALONE), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") == 1)
    )
    return sites.join(once.drop("_rows"), list(names), "left")


def core_of_charges(
    headers: DataFrame,
    charges: Charges,
    fleets: DataFrame,
    sites: DataFrame,
    key_type: str = "int",
    sides: Sides = SIDES,
) -> DataFrame:
    """``enrich_core`` of headers joined to their charges, clustered by ``SITE_REF``."""
    site = _alone(_site_attributes(sites, key_type)).hint("merge")
    rows = _attach(headers, _fleet_attributes(fleets), "fleetID").join(charges.rows, "invoiceID")
    rows = rows.join(site, F.col(charges.site) == F.col("siteID"), "left")
    rows = rows.withColumn(SITE_REF, F.col(charges.site))
    for level in charges.measures:
        rows = rows.withColumns({name: F.expr(sql) for name, sql in level.items()})
    return with_measures(rows, sides)


def enrich_fees(
    core: DataFrame, customers: DataFrame, corporation_types: DataFrame
) -> DataFrame:
    """Adds provider, brand and the cascading fee.

    Each of the two meets the fact on its own: Spark knows the size of either table, but takes a
    join of both for the product of their sizes.  A brand code that occurs twice doubles the rows.
    """
    brand = corporation_types.select(
        F.col("corporationType").alias("_brandCode"), F.col("aiFeePct").alias("_brandPct")
    )
    provider = customers.select(
        "customerID",
        F.col("customerCompanyName").alias("customerName"),
        "corpType",
        F.col("aiInvoiceFlatFee").alias("_flat"),
        F.col("aiInvoicePctFee").alias("_pct"),
    )
    fee = money.cascading_fee(
        F.col("invoiceTotalAmount"), F.col("_flat"), F.col("_pct"), F.col("_brandPct")
    )
    return (
        _attach(core, provider, "customerID")
        .join(brand, F.col("corpType") == F.col("_brandCode"), "left")
        .withColumn("totalAiFee", fee)
        .drop("_flat", "_pct", "_brandPct", "_brandCode")
    )


def invoice_enriched(
    invoices: DataFrame,
    fleets: DataFrame,
    sites: DataFrame,
    customers: DataFrame,
    corporation_types: DataFrame,
    key_type: str = "int",
    sides: Sides = SIDES,
    charges: Charges | None = None,
) -> DataFrame:
    """One row per invoice with all context, in the published column order.

    With ``charges`` the invoices are headers, and the result has one row per charge of a header and
    the two marks that let the month rollup do without a shuffle of its own.
    """
    if charges is None:
        core, marks = enrich_core(invoices, fleets, sites, key_type, sides), ()
    else:
        core = core_of_charges(invoices, charges, fleets, sites, key_type, sides)
        marks = (SITE_REF, SITE_ALONE)
    full = enrich_fees(core, customers, corporation_types)
    return full.select(
        "invoiceID", "invoiceNumber", "invoiceDate", "period",
        *_FLEET, *_SITE, *_CUSTOMER,
        "invoiceTotalAmount", "prepaidTotalAmount", sides.net_balance, "invoiceTaxTotalAmount",
        "invoiceTotalDiscounts", "invoiceCCFees", sides.fee, "totalAiFee", "voided",
        *marks,
    )


def with_ai_flag(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn(
        "isAiInvoice",
        keys.is_ai_invoice(
            F.col("invoiceBilledOutOnAutoIntegrate"), F.col("invoiceBillingFeesAutoIntegrate")
        ),
    )


def with_week(core: DataFrame) -> DataFrame:
    return core.withColumn("weekEnding", week_ending(F.col("invoiceDate")))


LINE_COLUMNS = (
    "invoiceItemBridgeID", "invoiceID", "serviceCatgCode", "itemDescription",
    "serviceActualQuantity", "serviceAmount", "serviceActualAmount",
)


def line_enriched(lines: DataFrame, core: DataFrame) -> DataFrame:
    """Line items with the period, fleet and store of their invoice.

    Every column list is explicit so that both sides of the one large join are pruned to it.
    """
    header = core.select(
        "invoiceID", "period", "fleetCode", "fleetName", "storeNumber", "siteName"
    )
    return lines.select(*LINE_COLUMNS).join(header, "invoiceID").select(
        *LINE_COLUMNS, "period", "fleetCode", "fleetName", "storeNumber", "siteName"
    )
