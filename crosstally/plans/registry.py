"""One runnable query per operator, on the bound test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampNTZType, TimestampType

from ..contract import VARIANCE
from ..functions import keys
from ..operators import (
    doccatalog,
    enrich,
    quality,
    reconcile,
    rollups,
    sales,
    scope,
)
from ..operators.filters import FilterBar
from ..schemas import REQUIRED
from ..session import tune
from ..sources import sheets
from .binding import AS_OF, KEY_TYPE, PART_RULES, SCOPE_CODES, TIERS, Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Result types every client can compare: exact decimals as doubles, midnights as dates.

    The only place where money leaves DECIMAL, after all sums are done.
    """
    cells = []
    for f in df.schema:
        if isinstance(f.dataType, DecimalType):
            cells.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            cells.append(F.col(f.name).cast("date").alias(f.name))
        else:
            cells.append(F.col(f.name))
    return df.select(*cells)


def query(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return present(f(Star(tune(spark), directory)))

    QUERIES[f.__name__] = run
    return f


# -- reconciliation ------------------------------------------------------------------------------


def _core(s: Star, search: str | None = None) -> DataFrame:
    return enrich.enrich_core(s.invoices(), s.fleets(), s.sites(), KEY_TYPE, search=search)


def _weekly(s: Star, bar: FilterBar = FilterBar(), kpi: DataFrame | None = None) -> DataFrame:
    rows = reconcile.reported_rows(s.partner_kpi() if kpi is None else kpi, KEY_TYPE)
    return reconcile.variance_fleet_store_week(bar.booked(_core(s, bar.search)), bar.reported(rows))


@query
def variance_fleet_store_week(s: Star) -> DataFrame:
    return _weekly(s)


@query
def variance_summary(s: Star) -> DataFrame:
    return reconcile.variance_summary(_weekly(s)).orderBy("reconStatus")


@query
def top_variances(s: Star) -> DataFrame:
    return reconcile.top_variances(_weekly(s))


@query
def variance_by_store(s: Star) -> DataFrame:
    return reconcile.variance_by_store(_weekly(s)).orderBy(F.col("absVariance").desc_nulls_last())


@query
def variance_by_fleet(s: Star) -> DataFrame:
    return reconcile.variance_by_fleet(_weekly(s)).orderBy(F.col("absVariance").desc_nulls_last())


@query
def variance_totals_row(s: Star) -> DataFrame:
    return reconcile.totals_row(_weekly(s))


@query
def variance_report_sets(s: Star) -> DataFrame:
    """All rollups of the report in one aggregation."""
    return reconcile.report_sets(_weekly(s))


@query
def variance_empty_reported(s: Star) -> DataFrame:
    return reconcile.variance_summary(_weekly(s, kpi=s.empty_kpi()))


@query
def variance_status_filter(s: Star) -> DataFrame:
    return reconcile.with_status(_weekly(s), VARIANCE)


@query
def variance_filtered(s: Star) -> DataFrame:
    bar = FilterBar(start=date(1997, 1, 1), end=date(1999, 6, 30), region="ASIA")
    return _weekly(s, bar)


@query
def variance_voided_include(s: Star) -> DataFrame:
    return reconcile.variance_summary(_weekly(s, FilterBar(voided="include")))


@query
def variance_voided_only(s: Star) -> DataFrame:
    return reconcile.variance_summary(_weekly(s, FilterBar(voided="only")))


@query
def variance_search(s: Star) -> DataFrame:
    return _weekly(s, FilterBar(search="SUPPLIER#00000001"))


@query
def variance_sorted_page(s: Star) -> DataFrame:
    return reconcile.display_page(_weekly(s))


@query
def variance_sorted_by_gross(s: Star) -> DataFrame:
    return reconcile.display_page(_weekly(s), "drivenGross")


# -- keys, flags, fees, enrichment ---------------------------------------------------------------


@query
def store_number_parse(s: Star) -> DataFrame:
    raw = F.col("storeNumber")
    return s.sites().select(
        "siteID", raw.alias("rawStore"), keys.store_number(raw, to=KEY_TYPE).alias("storeNumber")
    )


@query
def account_number_from_code(s: Star) -> DataFrame:
    code = F.col("fleetCode")
    return s.fleets().select("fleetID", "fleetCode", keys.account_number(code).alias("accountNumber"))


@query
def ai_invoice_flag(s: Star) -> DataFrame:
    return enrich.with_ai_flag(s.invoices()).groupBy("isAiInvoice").agg(
        F.count(F.lit(1)).alias("invoiceRows"),
        F.sum("invoiceTotalAmount").alias("totalInvoice"),
    )


@query
def ai_fee_cascade(s: Star) -> DataFrame:
    """Fees per provider."""
    rows = enrich.enrich_fees(
        enrich.with_measures(s.invoices()), s.customers(), s.corporation_types()
    )
    return rows.groupBy("customerID", "customerName", "corpType").agg(
        F.count(F.lit(1)).alias("invoiceRows"),
        F.sum("totalMfcFee").alias("totalMfcFee"),
        F.sum("totalAiFee").alias("totalAiFee"),
    )


def _enriched(s: Star) -> DataFrame:
    return enrich.invoice_enriched(
        s.invoices(), s.fleets(), s.sites(), s.customers(), s.corporation_types(), KEY_TYPE
    )


def _enriched_charges(s: Star) -> DataFrame:
    """The same rows, laid out for a rollup."""
    return enrich.invoice_enriched(
        s.invoice_headers(), s.fleets(), s.sites(), s.customers(), s.corporation_types(), KEY_TYPE,
        charges=s.invoice_charges(),
    )


@query
def invoice_enriched(s: Star) -> DataFrame:
    return _enriched(s)


@query
def fleet_store_month(s: Star) -> DataFrame:
    """Unsorted: a total order over the whole rollup costs more than the rollup itself."""
    return rollups.fleet_store_month(_enriched_charges(s))


@query
def fleet_store_month_preview(s: Star) -> DataFrame:
    return rollups.fleet_store_month(_enriched_charges(s)).orderBy(*rollups.month_order()).limit(50)


@query
def line_enriched(s: Star) -> DataFrame:
    core = enrich.enrich_core(s.order_invoices(), s.fleets(), s.sites(), KEY_TYPE)
    return enrich.line_enriched(s.lines(), core)


@query
def product_totals(s: Star) -> DataFrame:
    return rollups.product_totals(s.lines(), s.order_invoices()).orderBy(
        F.col("totalRevenue").desc_nulls_last()
    )


@query
def store_product_mix(s: Star) -> DataFrame:
    return rollups.store_product_mix(s.lines(), s.order_invoices(), s.sites(), KEY_TYPE).orderBy(
        F.col("storeNumber").asc_nulls_last(), F.col("revenue").desc_nulls_last()
    )


@query
def service_type_rollup(s: Star) -> DataFrame:
    return rollups.service_type_rollup(
        s.lines(), s.order_invoices(), s.fleets(), s.sites(), PART_RULES, key_type=KEY_TYPE
    )


# -- scoping and loading -------------------------------------------------------------------------


@query
def scope_customers(s: Star) -> DataFrame:
    return scope.scope_customers(s.customers(), SCOPE_CODES)


@query
def scope_sites(s: Star) -> DataFrame:
    return scope.scope_sites(s.sites())


@query
def scope_fleets_semi(s: Star) -> DataFrame:
    return scope.scope_fleets(
        s.fleets(), s.order_invoices(), s.customers(), AS_OF, SCOPE_CODES
    )


@query
def scope_invoices(s: Star) -> DataFrame:
    return scope.scope_invoices(s.invoices(), s.customers(), AS_OF, SCOPE_CODES)


@query
def scope_lines(s: Star) -> DataFrame:
    return scope.scope_lines(s.lines(), s.order_invoices(), s.customers(), AS_OF, SCOPE_CODES)


@query
def load_row_counts(s: Star) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return rollups.row_counts({n: s.table(n) for n in names}).orderBy("table_name")


@query
def kpi_normalise(s: Star) -> DataFrame:
    return sheets.typed_kpi(s.kpi_sheet()).select(
        "yearMonth", "date", "storeNumber", "weekEnding", "carsPerDay", "grossSales"
    )


# -- sales questions -----------------------------------------------------------------------------


@query
def q1_org_monthly(s: Star) -> DataFrame:
    return sales.org_monthly(s.header(), s.accounts())


@query
def q1_org_services(s: Star) -> DataFrame:
    return sales.org_services(s.header(), s.detail(), s.accounts(), rules=PART_RULES)


@query
def q1_one_org_monthly(s: Star) -> DataFrame:
    return sales.org_monthly(
        s.header(), s.accounts(), "NATION_7", date(1996, 1, 1), date(1998, 12, 31)
    )


@query
def q1_without_accounts(s: Star) -> DataFrame:
    return sales.org_monthly(s.header(), None)


@query
def sales_daily_cube(s: Star) -> DataFrame:
    return sales.daily_cube(s.header())


@query
def q2_revenue_by_year(s: Star) -> DataFrame:
    return sales.revenue_by_year(s.header())


@query
def q2_revenue_by_month(s: Star) -> DataFrame:
    return sales.revenue_by_month(s.header(), net=True)


@query
def q2_segment_revenue_by_year(s: Star) -> DataFrame:
    return sales.segment_revenue_by_year(s.header(), s.accounts())


@query
def q3_yoy_growth(s: Star) -> DataFrame:
    return sales.yoy_growth(s.header())


@query
def q3_seasonality(s: Star) -> DataFrame:
    return sales.seasonality(s.header())


@query
def q4_fleets_per_parent(s: Star) -> DataFrame:
    return sales.fleets_per_parent(s.accounts())


@query
def q5_service_mix(s: Star) -> DataFrame:
    return sales.service_mix(s.detail(), PART_RULES)


@query
def q6_size_tiers(s: Star) -> DataFrame:
    return sales.size_tiers(s.header(), s.accounts(), AS_OF, TIERS)


@query
def q6_account_tiers(s: Star) -> DataFrame:
    return sales.account_tiers(s.header(), s.accounts(), AS_OF, TIERS)


@query
def q7_inactive(s: Star) -> DataFrame:
    return sales.inactive_accounts(s.header(), s.accounts(), AS_OF)


@query
def q9_cancellations(s: Star) -> DataFrame:
    return sales.cancellations(s.accounts(), AS_OF)


@query
def q10_lost_revenue(s: Star) -> DataFrame:
    return sales.lost_revenue(s.header(), s.accounts())


@query
def q11_reasons(s: Star) -> DataFrame:
    return sales.cancellation_reasons(s.header(), s.accounts())


# -- quality checks ------------------------------------------------------------------------------


@query
def dq_required_nulls(s: Star) -> DataFrame:
    frames = {"invoice_header": s.header(), "invoice_detail": s.detail_lines(), "accounts": s.accounts()}
    tables = {t: (df, REQUIRED[t]) for t, df in frames.items()}
    tables["accounts"] = (s.accounts(), (*REQUIRED["accounts"], "parent_account_name"))
    return quality.required_nulls(tables)


@query
def dq_duplicate_keys(s: Star) -> DataFrame:
    return quality.duplicate_keys(
        {
            "invoice_header": (s.header(), ["invoice_id"]),
            "invoice_detail": (s.detail_lines(), ["invoice_id", "line_id"]),
        }
    )


@query
def dq_total_arithmetic(s: Star) -> DataFrame:
    return quality.total_arithmetic(s.header())


@query
def dq_subtotal_vs_lines(s: Star) -> DataFrame:
    return quality.subtotal_vs_lines(s.header(), s.detail_lines())


@query
def dq_dimension_fanout(s: Star) -> DataFrame:
    return quality.dimension_fanout(
        {
            "fleets": (s.fleets(), "fleetID"),
            "sites": (s.sites(), "siteID"),
            "customers": (s.customers(), "customerID"),
            "corporation_types": (s.corporation_types(), "corporationType"),
            "customers by brand": (s.customers(), "corpType"),
        }
    )


@query
def dq_store_collision(s: Star) -> DataFrame:
    both = s.sites().select("siteID", "storeNumber").unionByName(s.second_brand_sites())
    return quality.store_collisions(both, KEY_TYPE)


@query
def dq_line_arithmetic(s: Star) -> DataFrame:
    return quality.line_arithmetic(s.detail())


@query
def dq_orphans(s: Star) -> DataFrame:
    return quality.orphans(
        {
            "invoice_header.account_id": (s.header(), "account_id", s.accounts(), "account_id"),
            "invoice_detail.invoice_id": (s.detail_lines(), "invoice_id", s.header(), "invoice_id"),
            "invoices.fleetID": (s.order_invoices(), "fleetID", s.fleets(), "fleetID"),
        }
    )


@query
def dq_key_audit(s: Star) -> DataFrame:
    """Keys and the references to them, each key in one pass."""
    return quality.key_audit(
        {
            "invoice_header": (
                s.header(), "invoice_id", "duplicate_keys",
                {"invoice_detail.invoice_id": (s.detail_lines(), "invoice_id")},
            ),
            "accounts": (
                s.accounts(), "account_id", "dimension_fanout",
                {"invoice_header.account_id": (s.header(), "account_id")},
            ),
            "fleets": (
                s.fleets(), "fleetID", "dimension_fanout",
                {"invoices.fleetID": (s.order_invoices(), "fleetID")},
            ),
        }
    )


@query
def dq_bad_join_keys(s: Star) -> DataFrame:
    names = ("fleetAccountNumber", "storeNumber")
    return quality.bad_join_keys(
        {
            "booked": (_core(s), names),
            "reported": (reconcile.reported_rows(s.partner_kpi(), KEY_TYPE), names),
        }
    )


# -- documents -----------------------------------------------------------------------------------


@query
def doc_catalog_summary(s: Star) -> DataFrame:
    """In order of names; sorted as texts, before these are parsed into wider rows."""
    return doccatalog.document_summary(s.metadata_files().orderBy("file_name"))


@query
def doc_catalog_hand_edited(s: Star) -> DataFrame:
    """What is one JSON object, and what counts as deleted."""
    found = doccatalog.document_summary(s.odd_metadata_files())
    return found.select("file_name", "kind", "deleted", "line")


@query
def doc_name_search(s: Star) -> DataFrame:
    return doccatalog.name_search(s.metadata_files(), "License")


@query
def doc_ext_counts(s: Star) -> DataFrame:
    return doccatalog.extension_counts(s.document_files())
