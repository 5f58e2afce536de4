"""The month rollup of headers and charges: the rows of the plain one, and few rows shuffled."""

import io
from collections import Counter
from contextlib import contextmanager, redirect_stdout

from pyspark.sql import functions as F

from crosstally.operators import enrich, rollups
from crosstally.plans.binding import Star
from crosstally.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
#: Partitions of a few KB count as skewed.
SKEW = NO_BROADCAST | {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
}
HEADER = "invoiceID BIGINT, invoiceNumber STRING, fleetID BIGINT, invoiceDate TIMESTAMP, voided INT"
CHARGE = "invoiceID BIGINT, site BIGINT, total DECIMAL(18,2), rate DECIMAL(4,2)"
MEASURES = (
    {"invoiceTotalAmount": "total", "invoiceTaxTotalAmount": "CAST(total * rate AS DECIMAL(18,2))"},
    {
        "customerID": "site % 2",
        "prepaidTotalAmount": "CASE WHEN site > 2 THEN invoiceTaxTotalAmount END",
        "invoiceTotalDiscounts": "total",
        "invoiceCCFees": "CAST(NULL AS DECIMAL(18,2))",
        "invoiceInvoiceFee": "CAST(1 AS DECIMAL(18,2))",
    },
)


@contextmanager
def settings(spark, values):
    saved = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def both(headers, rows, fleets, sites, customers, brands):
    """The rollup of headers and charges, and that of their join."""
    dims = fleets, sites, customers, brands
    invoices = headers.join(rows, "invoiceID")
    for level in MEASURES:
        invoices = invoices.withColumns({k: F.expr(v) for k, v in level.items()})
    plain = enrich.invoice_enriched(invoices.withColumnRenamed("site", "siteID"), *dims)
    marked = enrich.invoice_enriched(headers, *dims, charges=enrich.Charges(rows, "site", MEASURES))
    return rollups.fleet_store_month(marked), rollups.fleet_store_month(plain)


def providers(frame):
    customers = frame([(0, "A", "X", "1.50", None), (1, "B", None, None, "0.01")],
                      "customerID BIGINT, customerCompanyName STRING, corpType STRING,"
                      " aiInvoiceFlatFee DECIMAL(18,2), aiInvoicePctFee DECIMAL(9,6)")
    return customers, frame([("X", "0.02")], "corporationType STRING, aiFeePct DECIMAL(9,6)")


def test_months_of_charges_are_those_of_the_joined_rows(spark, frame):
    fleets = frame(
        # Two fleets of one code and name, an id of two rows, a fleet without names.
        [(1, "MBL-1", 1, "One"), (2, "MBL-2", 2, "Two"), (3, "MBL-2", 2, "Two"), (4, "MBL-4", 4, "Four"),
         (4, "MBL-5", 5, "Five"), (6, None, None, None)],
        "fleetID BIGINT, fleetCode STRING, fleetAccountNumber BIGINT, fleetAccountName STRING")
    sites = frame(
        # Alone; 2 and 3 share number and name; 4 twice under two names, one of them also 5's; 6 twice
        # the same; without number; without name; with neither, as a miss looks; one without an id.
        [(1, "T5C1", "One"), (2, "T5C2", "Two"), (3, "MBL2", "Two"), (4, "T5C4", "Four"), (4, "T5C5", "Five"),
         (5, "T5C5", "Five"), (6, "T5C6", "Six"), (6, "T5C6", "Six"), (7, "junk", "Seven"), (8, "T5C8", None),
         (9, "junk", None), (None, "T5C10", "Ten"), (10, "T5C10", "Ten"), (11, "T5C2", "Eleven")],
        "siteID BIGINT, storeNumber STRING, siteName STRING").selectExpr(
        "*", "'r' AS region", "'d' AS district", "'v' AS division")
    fleet_of = [1, 2, 3, 4, 5, 6, None]
    headers = frame(
        [(i, f"INV-{i}", fleet_of[i % 7], f"2026-0{1 + i % 2}-1{i % 3} 0{i % 9}:00:00", i % 2) for i in range(60)]
        + [(7, "INV-7b", 2, "2026-01-31 00:00:00", None), (None, "none", 1, "2026-01-01 00:00:00", 0)], HEADER)
    # Site 12 and None are missing; every invoice has charges at both sites that share their names.
    site_of = [*range(1, 13), None]
    rows = frame([(i, s, f"{10 * i + (s or 0)}.25", None if s == 5 else "0.07") for i in range(62) for s in site_of]
                 + [(1, 1, None, "0.01"), (1, 1, "3.00", "0.01"), (None, 1, "1.00", "0.01")], CHARGE)
    for conf in ({}, NO_BROADCAST):
        with settings(spark, conf):
            got, want = both(headers, rows, fleets, sites, *providers(frame))
            assert got.schema == want.schema
            assert Counter(got.collect()) == Counter(want.collect())
    counts = {(r.fleetCode, r.siteName): r.invoiceCount for r in got.collect() if str(r.period) == "2026-01-01"}
    assert counts["MBL-1", "Two"] == counts["MBL-1", "One"] > 0  # once per invoice, not once per site


def shuffled_rows(df):
    """Rows written by all shuffles of a query that ran; a shuffle that is read again counts once."""

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "ReusedExchange":
            return 0
        own = node.metrics().get("shuffleRecordsWritten")
        own = own.get().value() if node.nodeName() == "Exchange" and own.isDefined() else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_line_items_are_shuffled_twice(spark):
    """To their order and to their site, where their months are.  Providers and brands are broadcast."""
    star = Star(spark, SF)
    lines = star.table("lineitem").count()
    others = sum(star.table(t).count() for t in ("orders", "customer", "supplier"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "16k"}):
        df = QUERIES["fleet_store_month"](spark, SF)
        assert df.collect()
        moved = shuffled_rows(df)
    assert 2 * lines <= moved < 2.1 * lines + 3 * others, moved / lines


def test_charges_and_headers_are_the_invoices(spark):
    star = Star(spark, SF)
    want = star.invoices()
    rows = star.invoice_headers().join(star.invoice_charges().rows, "invoiceID")
    for level in star.invoice_charges().measures:
        rows = rows.withColumns({k: F.expr(v) for k, v in level.items()})
    names = [c for c in want.columns if c in rows.columns]
    assert set(want.columns) - set(names) == {
        "siteID", "invoiceBilledOutOnAutoIntegrate", "invoiceBillingFeesAutoIntegrate"}
    got = rows.withColumnRenamed("l_suppkey", "siteID").select("siteID", *names)
    want = want.select("siteID", *names)
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_small_columns_come_back_whatever_their_values(spark, tmp_path):
    """Also the ends of their types, and NULLs."""
    lines = spark.range(7 * 7 * 6).selectExpr(
        "id AS l_orderkey", "id AS l_suppkey", "CAST(1 AS DOUBLE) AS l_extendedprice", "'R' AS l_returnflag",
        "element_at(array(0.0D, 0.01D, -0.01D, 99.99D, -99.99D, 0.29D, NULL), CAST(id % 7 + 1 AS INT)) AS l_discount",
        "element_at(array(0.0D, 0.01D, -0.01D, 99.99D, -99.99D, 0.57D, NULL), CAST(id div 7 % 7 + 1 AS INT)) AS l_tax",
        "element_at(array(0, 1, -1, 2147483647, CAST(-2147483648 AS INT), NULL), CAST(id div 49 + 1 AS INT))"
        " AS l_linenumber")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    charges = Star(spark, str(tmp_path)).invoice_charges()
    back = charges.rows.withColumns({k: F.expr(v) for k, v in charges.measures[0].items()})
    got = back.select("invoiceID", "l_linenumber", "l_discount", "l_tax")
    want = lines.selectExpr("l_orderkey", "l_linenumber", "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))")
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_site_is_split_and_gives_whole_months(spark, frame):
    hot, all_rows = 30_000, 60_000
    headers = spark.range(all_rows // 3).selectExpr(
        "id AS invoiceID", "concat('INV-', id) AS invoiceNumber", f"IF(id < {hot // 3}, 7, id % 1000) AS fleetID",
        "CAST(date_add(DATE '2026-01-01', CAST(id % 60 AS INT)) AS TIMESTAMP) AS invoiceDate", "0 AS voided")
    rows = spark.range(all_rows).selectExpr(
        "id div 3 AS invoiceID", f"IF(id < {hot}, 3, id % 50) AS site",
        "CAST(xxhash64(id) % 1000000 AS DECIMAL(18,2)) AS total", "CAST(0.07 AS DECIMAL(4,2)) AS rate").repartition(8)
    fleets = spark.range(1000).selectExpr("id AS fleetID", "concat('MBL-', id) AS fleetCode",
                                          "id AS fleetAccountNumber", "concat('F', id) AS fleetAccountName")
    sites = spark.range(50).selectExpr("id AS siteID", "concat('T5C', id) AS storeNumber", "concat('S', id) AS siteName",
                                       "'r' AS region", "'d' AS district", "'v' AS division")
    with settings(spark, SKEW):
        got, want = both(headers, rows, fleets, sites, *providers(frame))
        assert Counter(got.collect()) == Counter(want.collect())
        out = io.StringIO()
        with redirect_stdout(out):
            got.explain()
    assert "skew=true" in out.getvalue()
