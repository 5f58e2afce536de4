"""Physical plans: what must and must not appear, and results under a hot key."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from crosstally.operators import enrich, reconcile, sales
from crosstally.operators.scope import scope_customers, scope_invoices
from crosstally.plans.binding import AS_OF, Star
from crosstally.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
UNBOUNDED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas")
#: Windows over one row per year or per calendar month.
BOUNDED_WINDOWS = {"q3_yoy_growth", "q3_seasonality"}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    """The joins that tables beyond the threshold get."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def check_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [word for word in UNBOUNDED if word in text]
    assert "Window" not in text or name in BOUNDED_WINDOWS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_no_python_no_unpartitioned_window(spark, name):
    check_plan(spark, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nor_with_tables_beyond_the_broadcast_threshold(spark, no_broadcast, name):
    check_plan(spark, name)


def test_building_a_query_runs_no_data_job(spark):
    """But for footers of files that are new to the session."""
    tracker = spark.sparkContext.statusTracker()
    for name in ("variance_summary", "fleet_store_month", "line_enriched"):
        QUERIES[name](spark, SF)  # reads footers
        spark.sparkContext.setJobGroup("building", name)
        QUERIES[name](spark, SF)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("building")]
        tasks = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds)
        assert tasks == len(jobs)  # a footer is read by one task
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_every_customer_and_supplier_takes_part(spark):
    star = Star(spark, "/root/testdata/sf0.1")
    sites = star.order_invoices().select("siteID").distinct()
    used = sites.join(star.table("supplier"), F.col("siteID") == F.col("s_suppkey"), "left_semi")
    assert used.count() == sites.count()
    ordering = star.table("orders").select((F.col("o_custkey") / 15).cast("int").alias("k")).distinct()
    assert used.count() == ordering.count() >= 0.99 * star.table("supplier").count()
    assert star.fleets().count() == star.table("customer").count()
    assert star.partner_kpi().count() == star.table("lineitem").count()


@pytest.fixture
def customers(spark, tmp_path):
    """The providers as a stored table."""
    Star(spark, SF).customers().write.parquet(str(tmp_path / "customers"))
    return spark.read.parquet(str(tmp_path / "customers"))


def test_window_and_brand_predicates_reach_the_scan(spark, customers):
    text = plan(scope_invoices(Star(spark, SF).invoices(), customers, AS_OF, ("ASIA",)))
    assert "GreaterThanOrEqual(o_orderdate,2001-05-01" in text
    assert "EqualTo(corpType,ASIA)" in text or "In(corpType, [ASIA])" in text


def test_unknown_voided_rows_are_kept_by_a_predicate_that_reaches_the_scan(spark, tmp_path):
    from crosstally.operators.scope import not_voided_lenient

    path = str(tmp_path / "v")
    spark.range(10).selectExpr("CAST(id % 2 AS INT) AS voided").write.parquet(path)
    text = plan(spark.read.parquet(path).filter(not_voided_lenient(F.col("voided"))))
    assert "PushedFilters: [Or(IsNull(voided),EqualTo(voided,0))]" in text


def test_scans_read_only_the_needed_columns(spark):
    text = plan(QUERIES["variance_summary"](spark, SF))
    scans = [line for line in text.split("\n") if "FileScan" in line and "lineitem" in line]
    assert scans
    for scan in scans:
        assert "l_shipdate" not in scan and "l_partkey" not in scan and "l_tax" not in scan


def test_service_mix_scans_the_details_once(spark):
    df = sales.service_mix(Star(spark, SF).detail())
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_names_are_searched_in_texts_parsed_once(spark):
    text = plan(QUERIES["doc_name_search"](spark, SF))
    assert text.count("parseJson(") == 1


def test_questions_on_few_accounts_aggregate_few_accounts(spark, no_broadcast, tmp_path):
    """On stored columns, from which nothing can be inferred."""
    star = Star(spark, SF)
    for name in ("header", "accounts", "detail"):
        getattr(star, name)().write.parquet(str(tmp_path / name))
    header, accounts, detail = (spark.read.parquet(str(tmp_path / n)) for n in ("header", "accounts", "detail"))
    for df in (
        sales.lost_revenue(header, accounts),
        sales.org_monthly(header, accounts, "NATION_7"),
        sales.org_services(header, detail, accounts, "NATION_7"),
    ):
        lines = plan(df).split("\n")
        # The join with the few accounts stands below the aggregation of the facts.
        few = next(i for i, x in enumerate(lines) if "LeftSemi" in x or ("account_id" in x and "Inner" in x))
        assert any("Aggregate" in x and "sum" in x for x in lines[:few])


HOT, ALL = 30_000, 60_000


@pytest.fixture
def hot(spark):
    """Half of the invoices belong to one fleet, store and day; a fifth of all rows to one id."""
    rows = spark.range(ALL).selectExpr(
        f"IF(id < {ALL // 5}, 0, id) AS invoiceID",
        f"IF(id < {HOT}, 7, id % 1000) AS fleetID",
        f"IF(id < {HOT}, 3, id % 50) AS siteID",
        f"CAST(date_add(DATE '2026-01-01', CAST(IF(id < {HOT}, 0, id % 60) AS INT)) AS TIMESTAMP)"
        " AS invoiceDate",
        "CAST(xxhash64(id) % 1000000 AS DECIMAL(18,2)) AS invoiceTotalAmount",
        "CAST(NULL AS DECIMAL(18,2)) AS prepaidTotalAmount",
        "CAST(xxhash64(-id) % 1000000 AS DECIMAL(18,2)) AS invoiceTotalDiscounts",
        "CAST(NULL AS DECIMAL(18,2)) AS invoiceInvoiceFee",
        "1 AS customerID",
        "0 AS voided",
    )
    fleets = spark.range(1000).selectExpr(
        "id AS fleetID", "concat('MBL-', id) AS fleetCode", "id AS fleetAccountNumber",
        "concat('F', id) AS fleetAccountName")
    sites = spark.range(50).selectExpr(
        "id AS siteID", "concat('T5C', id) AS storeNumber", "concat('S', id) AS siteName",
        "'r' AS region", "'d' AS district", "'v' AS division")
    return rows, fleets, sites


def test_hot_keys_are_split_and_give_whole_results(spark, hot):
    rows, fleets, sites = hot
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    saved = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        weekly = reconcile.booked_week(enrich.enrich_core(rows.repartition(8), fleets, sites))
        got = weekly.collect()
        text = plan(weekly)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert "skew=true" in text  # the hot fleet and store were split over several tasks
    assert sum(r.mfcTotalInvoice for r in got) == rows.agg(F.sum("invoiceTotalAmount")).first()[0]
    want = rows.filter("fleetID = 7 AND siteID = 3 AND invoiceDate < '2026-01-04'").agg(
        F.count_distinct("invoiceID"), F.sum("invoiceTotalAmount")
    ).first()
    top = max(got, key=lambda r: r.mfcInvoiceCount)
    assert (top.fleetAccountNumber, top.storeNumber) == (7, 3)
    assert (top.mfcInvoiceCount, top.mfcTotalInvoice) == tuple(want)


def test_scoped_customers_is_a_plain_in(customers):
    scoped = scope_customers(customers, ("ASIA", "EUROPE"))
    assert "In(corpType, [ASIA,EUROPE])" in plan(scoped) and scoped.count() == 10
