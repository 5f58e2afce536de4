"""The reconciliation and sales pipelines on tables in their own schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import BRAND_CODES, PREVIEW_ROWS, SIDES, SOURCE_TABLES, TOLERANCE, Sides
from ..operators import enrich, reconcile, rollups, sales, scope
from ..operators.filters import FilterBar
from ..schemas import RECONCILIATION_TABLES, SALES_TABLES
from ..sources import files, sheets, sinks, store, tables


@dataclass(frozen=True)
class Tables:
    """The seven reconciliation tables."""

    corporation_types: DataFrame
    customers: DataFrame
    sites: DataFrame
    fleets: DataFrame
    invoices: DataFrame
    invoice_item_bridge: DataFrame
    partner_kpi: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def scoped(
    raw: Tables, as_of: date, codes: Sequence[str] = BRAND_CODES, months_back: int = 3
) -> Tables:
    """The six extracts: every table cut down to the brand list and the rolling window.

    The scoped invoices are written once to the shared folder; fleets and lines follow from that
    table, so the source is asked for its invoices once.  Whoever is done with the extracts
    removes it (``sinks.remove``); ``extract`` does.
    """
    invoices = sinks.materialise(
        scope.scope_invoices(raw.invoices, raw.customers, as_of, codes, months_back),
        "scoped_invoices",
    )
    return replace(
        raw,
        customers=scope.scope_customers(raw.customers, codes),
        sites=scope.scope_sites(raw.sites, codes),
        fleets=scope.fleets_of(raw.fleets, invoices),
        invoices=invoices,
        invoice_item_bridge=scope.lines_of(raw.invoice_item_bridge, invoices),
    )


def write_extracts(extracts: Tables, directory: str) -> dict[str, int]:
    """One CSV folder per table; returns the rows written."""
    return {
        name: sinks.write_csv(df, f"{directory}/{name}.csv")
        for name, df in extracts.as_dict().items()
    }


def extract(
    raw: Tables, directory: str, as_of: date, codes: Sequence[str] = BRAND_CODES, months_back: int = 3
) -> dict[str, int]:
    """Scopes and writes the extracts, and deletes the intermediate table of scoped invoices."""
    extracts = scoped(raw, as_of, codes, months_back)
    written = write_extracts(extracts, directory)
    sinks.remove(extracts.invoices)
    return written


def load_csv(spark: SparkSession, directory: str) -> Tables:
    """The extracts from CSV; the partner KPI may be absent."""
    frames = {
        name: tables.read_csv(spark, f"{directory}/{name}.csv", name)
        for name in RECONCILIATION_TABLES
        if name != "partner_kpi"
    }
    kpi = tables.read_optional_csv(spark, f"{directory}/partner_kpi.csv", "partner_kpi")
    return Tables(**frames, partner_kpi=kpi)


def load_kpi_sheet(spark: SparkSession, directory: str, path: str | None = None) -> DataFrame:
    """The partner's sheet (saved as CSV), typed: the given file, or the latest one by name."""
    sheet = tables.read_text_csv(spark, path or files.latest_file(spark, directory))
    return sheets.typed_kpi(sheet)


#: Key of each fact in the source, by which it is read in parts.
FACT_KEYS = {"invoices": "InvoiceID", "invoice_item_bridge": "InvoiceItemBridgeID"}


def read_database(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    parts: int,
    as_of: date | None = None,
    codes: Sequence[str] = BRAND_CODES,
    months_back: int = 3,
) -> Tables:
    """The six source tables, lazily but for the bounds of the parts.

    With ``as_of`` the database scopes them itself and sends the six extracts; without, ``scoped``
    does, and pushes what it can of its filters.  The two facts are read in ``parts`` parts of
    equal size, whose bounds the database is asked for.
    """
    frames = {}
    for name in SOURCE_TABLES:
        source = name if as_of is None else tables.scoped_select(name, as_of, codes, months_back)
        if name in FACT_KEYS:
            frames[name] = tables.read_jdbc_split(
                spark, url, source, name, FACT_KEYS[name], parts, properties
            )
        else:
            options = tables.jdbc_options(url, source, properties)
            frames[name] = tables.read_jdbc(spark, options, name)
    return Tables(**frames, partner_kpi=tables.stub(spark, "partner_kpi"))


def load_parquet(spark: SparkSession, directory: str) -> Tables:
    """The tables at rest, as the last load that ended left them."""
    return Tables(**store.read_tables(spark, directory))


def store_parquet(loaded: Tables, directory: str, buckets: int | None = None) -> Tables:
    """Replaces the tables at rest and returns scans of them.

    With ``buckets`` invoices and lines join without a shuffle, and date filters read their months
    only.
    """
    return Tables(**store.replace_tables(loaded.as_dict(), directory, buckets))


def weekly_variance(
    t: Tables,
    bar: FilterBar = FilterBar(),
    tolerance: Decimal = TOLERANCE,
    sides: Sides = SIDES,
    key_type: str = "int",
) -> DataFrame:
    """Filtered weekly variance; the default filter only drops voided invoices."""
    core = enrich.enrich_core(t.invoices, t.fleets, t.sites, key_type, sides, bar.search)
    reported = reconcile.reported_rows(t.partner_kpi, key_type)
    return reconcile.variance_fleet_store_week(
        bar.booked(core), bar.reported(reported), tolerance, sides
    )


def _down(name: str):
    return F.col(name).desc_nulls_last()


def _up(name: str):
    return F.col(name).asc_nulls_last()


def views(t: Tables, weekly: DataFrame | None = None, sides: Sides = SIDES) -> dict[str, DataFrame]:
    """Every published view, in its published order.

    ``weekly`` may be a written copy of the weekly variance, which five of the views share.
    """
    enriched = enrich.invoice_enriched(
        t.invoices, t.fleets, t.sites, t.customers, t.corporation_types, sides=sides
    )
    core = enrich.enrich_core(t.invoices, t.fleets, t.sites, sides=sides)
    weekly = weekly_variance(t, sides=sides) if weekly is None else weekly
    lines, invoices = t.invoice_item_bridge, t.invoices
    return {
        "v_invoice_enriched": enriched,
        "v_fleet_store_month": rollups.fleet_store_month(enriched, sides).orderBy(
            *rollups.month_order()
        ),
        "v_line_enriched": enrich.line_enriched(lines, core),
        "v_product_totals": rollups.product_totals(lines, invoices).orderBy(_down("totalRevenue")),
        "v_store_product_mix": rollups.store_product_mix(lines, invoices, t.sites).orderBy(
            _up("storeNumber"), _down("revenue")
        ),
        "v_service_type_rollup": rollups.service_type_rollup(
            lines, invoices, t.fleets, t.sites
        ).orderBy(_down("period"), _up("fleetCode"), _up("storeNumber"), _down("revenue")),
        "v_variance_fleet_store_week": weekly,
        "v_variance_summary": reconcile.variance_summary(weekly, sides).orderBy("reconStatus"),
        "v_top_variances": reconcile.top_variances(weekly),
        "v_variance_by_store": reconcile.variance_by_store(weekly).orderBy(_down("absVariance")),
        "v_variance_by_fleet": reconcile.variance_by_fleet(weekly).orderBy(_down("absVariance")),
    }


def month_preview(t: Tables, rows: int = PREVIEW_ROWS, sides: Sides = SIDES) -> DataFrame:
    return views(t, sides=sides)["v_fleet_store_month"].limit(rows)


def register(t: Tables, weekly: DataFrame | None = None, sides: Sides = SIDES) -> list[str]:
    """Makes tables and views available to ``spark.sql``; returns the names."""
    return register_frames({**t.as_dict(), **views(t, weekly, sides)})


def register_frames(frames: Mapping[str, DataFrame]) -> list[str]:
    """Temporary views for ad-hoc SQL, replacing those of the same name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def report(
    t: Tables,
    directory: str,
    bar: FilterBar = FilterBar(),
    status: str = "all",
    sides: Sides = SIDES,
) -> dict[str, int]:
    """Writes the variance report as CSV: the rows of one status in full, and every rollup.

    The weekly variance is written once to the shared folder.  One aggregation of that table gives
    the four rollups, whose few rows are written once too.  Returns rows written per output.
    """
    weekly = sinks.materialise(weekly_variance(t, bar, sides=sides), "weekly_variance")
    sets = sinks.materialise(reconcile.report_sets(weekly, sides), "report_sets")
    outputs = {"variance": reconcile.with_status(weekly, status), **reconcile.report_outputs(sets, sides)}
    written = {n: sinks.write_csv(df, f"{directory}/{n}.csv") for n, df in outputs.items()}
    sinks.remove(weekly)
    sinks.remove(sets)
    return written


# -- sales ---------------------------------------------------------------------------------------


def load_sales(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables of a drop folder by role; details and accounts may be absent."""
    found = files.read_routed(spark, directory)
    if "invoice_header" not in found:
        raise FileNotFoundError(f"no invoice header file in {directory}")
    return found


def sales_cards(
    loaded: Mapping[str, DataFrame],
    as_of: date,
    tiers: Sequence[tuple[str, int]],
    net: bool = False,
    cube: DataFrame | None = None,
) -> dict[str, DataFrame | str]:
    """Every sales question; for one that lacks a table, what it needs.

    ``cube`` may be a written ``sales.daily_cube`` of the headers, which ten of them then share.
    """
    header, detail, accounts = (loaded.get(t) for t in SALES_TABLES)
    days = header if cube is None else cube
    cards: dict[str, tuple[str, Callable[[], DataFrame]]] = {
        "q1_monthly": ("", lambda: sales.org_monthly(days, accounts, net=net)),
        "q1_services": ("invoice_detail", lambda: sales.org_services(header, detail, accounts)),
        "q2_years": ("", lambda: sales.revenue_by_year(days, net)),
        "q2_months": ("", lambda: sales.revenue_by_month(days, net)),
        "q2_segments": ("accounts", lambda: sales.segment_revenue_by_year(days, accounts, net=net)),
        "q3_growth": ("", lambda: sales.yoy_growth(days, net)),
        "q3_seasonality": ("", lambda: sales.seasonality(days, net)),
        "q4_fleets": ("accounts", lambda: sales.fleets_per_parent(accounts)),
        "q5_services": ("invoice_detail", lambda: sales.service_mix(detail)),
        "q6_tiers": ("accounts", lambda: sales.size_tiers(days, accounts, as_of, tiers, net)),
        "q7_inactive": ("accounts", lambda: sales.inactive_accounts(days, accounts, as_of)),
        "q9_cancellations": ("accounts", lambda: sales.cancellations(accounts, as_of)),
        "q10_lost_revenue": ("accounts", lambda: sales.lost_revenue(days, accounts, net=net)),
        "q11_reasons": ("accounts", lambda: sales.cancellation_reasons(days, accounts, net=net)),
    }
    return {
        name: build() if not needs or needs in loaded else f"needs {needs}"
        for name, (needs, build) in cards.items()
    }


def sales_report(
    loaded: Mapping[str, DataFrame],
    directory: str,
    as_of: date,
    tiers: Sequence[tuple[str, int]],
    net: bool = False,
) -> dict[str, int | str]:
    """Writes every card that can be answered as CSV; rows written, or what is missing.

    The headers are reduced to their daily cube once; only the service breakdown reads them again.
    """
    cube = sinks.materialise(sales.daily_cube(loaded["invoice_header"]), "sales_cube")
    written = {
        name: card if isinstance(card, str) else sinks.write_csv(card, f"{directory}/{name}.csv")
        for name, card in sales_cards(loaded, as_of, tiers, net, cube).items()
    }
    sinks.remove(cube)
    return written
