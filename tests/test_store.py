"""Tables at rest: replacement, layout of the facts, what plans make of it."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crosstally.operators import enrich, scope
from crosstally.operators.filters import FilterBar
from crosstally.plans import pipeline
from crosstally.schemas import schema
from crosstally.sources import store


def table(spark, name, rows):
    fields = schema(name)
    return spark.createDataFrame([[r.get(f.name) for f in fields] for r in rows], fields)


@pytest.fixture
def loaded(spark):
    invoices = [
        {"invoiceID": i, "customerID": 1, "fleetID": i % 3, "siteID": i % 4,
         "invoiceDate": datetime(2026, 1 + i % 4, 1 + i % 28) if i % 10 else None,
         "invoiceTotalAmount": Decimal(i), "voided": 0} for i in range(200)
    ]
    lines = [{"invoiceItemBridgeID": i, "invoiceID": i // 2, "serviceCatgCode": "C", "serviceActualAmount": Decimal(1)}
             for i in range(400)]
    rows = {
        "invoices": invoices, "invoice_item_bridge": lines, "partner_kpi": [], "corporation_types": [],
        "sites": [{"siteID": i, "storeNumber": f"T5C{i}", "siteName": f"S{i}"} for i in range(4)],
        "fleets": [{"fleetID": i, "fleetAccountNumber": i, "fleetAccountName": f"F{i}"} for i in range(3)],
        "customers": [{"customerID": 1, "corpType": "T5C"}],
    }
    return pipeline.Tables(**{name: table(spark, name, r) for name, r in rows.items()})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda: spark.conf.set(key, "-1")
    spark.conf.set(key, before)


def rows_of(t):
    return {n: sorted(map(repr, df.drop(scope.MONTH).collect())) for n, df in t.as_dict().items()}


@pytest.mark.parametrize("buckets", [None, 4])
def test_what_is_stored_is_read(spark, loaded, tmp_path, buckets):
    folder = str(tmp_path / "rest")
    stored = pipeline.store_parquet(loaded, folder, buckets)
    assert rows_of(stored) == rows_of(loaded) == rows_of(pipeline.load_parquet(spark, folder))


def test_a_load_may_read_what_it_replaces(spark, loaded, tmp_path):
    folder = str(tmp_path / "rest")
    first = pipeline.store_parquet(loaded, folder, 4)
    half = pipeline.replace(first, invoices=first.invoices.filter("invoiceID < 100"))
    second = pipeline.store_parquet(half, folder, 4)
    assert second.invoices.count() == 100 and first.invoices.count() == 200  # the version before stays
    pipeline.store_parquet(second, folder, 4)
    assert len([f for f in os.listdir(folder) if f.startswith("v-")]) == 2


def test_a_load_that_fails_leaves_the_old_tables(spark, loaded, tmp_path):
    folder = str(tmp_path / "rest")
    pipeline.store_parquet(loaded, folder, 4)
    broken = loaded.invoice_item_bridge.withColumn("itemDescription", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        pipeline.store_parquet(pipeline.replace(loaded, invoice_item_bridge=broken), folder, 4)
    assert rows_of(pipeline.load_parquet(spark, folder)) == rows_of(loaded)
    # The next load clears what the failed one left.
    pipeline.store_parquet(loaded, folder, 4)
    assert len([f for f in os.listdir(folder) if f.startswith("v-")]) == 2


def test_no_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pipeline.load_parquet(spark, str(tmp_path))


def test_facts_join_without_a_shuffle(spark, loaded, tmp_path, no_broadcast):
    """In another session of the catalog too: reading enters the buckets again."""
    folder = str(tmp_path / "rest")
    pipeline.store_parquet(loaded, folder, 4)
    version = store.pointer(spark, folder)["version"]
    for name in store.LAYOUTS:
        spark.sql(f"DROP TABLE {store._catalog_name(version, name)}")
    t = pipeline.load_parquet(spark, folder)
    mixed = pipeline.views(t)["v_line_enriched"]
    assert "hashpartitioning(invoiceID" not in plan(mixed) and mixed.count() == 400
    no_broadcast()
    joined = t.invoice_item_bridge.join(t.invoices.select("invoiceID", "siteID"), "invoiceID")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and joined.count() == 400


def test_windows_read_their_months_only(spark, loaded, tmp_path):
    t = pipeline.store_parquet(loaded, str(tmp_path / "rest"), 4)
    recent = scope.scope_invoices(t.invoices, t.customers, date(2026, 4, 30), ["T5C"], 1)
    bar = FilterBar(start=date(2026, 2, 10), end=date(2026, 3, 5))
    booked = bar.booked(enrich.enrich_core(t.invoices, t.fleets, t.sites))
    for df in (recent, booked):
        filters = [line for line in plan(df).splitlines() if "PartitionFilters" in line and "invoiceMonth" in line]
        assert filters and "PartitionFilters: []" not in filters[0]
    plain = scope.scope_invoices(loaded.invoices, loaded.customers, date(2026, 4, 30), ["T5C"], 1)
    assert recent.count() == plain.count() > 0
    assert booked.count() == bar.booked(enrich.enrich_core(loaded.invoices, loaded.fleets, loaded.sites)).count() > 0
