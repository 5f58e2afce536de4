"""Reconciliation on small tables in the native schema, against brute force."""

import random
from collections import defaultdict
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crosstally.contract import Sides
from crosstally.operators import enrich, reconcile, rollups, scope
from crosstally.operators.filters import FilterBar, between_days
from crosstally.plans import pipeline
from crosstally.plans.pipeline import Tables
from crosstally.schemas import schema
from crosstally.sources.tables import stub

CODES = ["T5C0001", "T5C0002828", "MBL0001", "T5CX828", "T5C0003"]
START = date(2026, 1, 1)


def table(spark, name, rows):
    """Rows as dicts, other columns NULL."""
    fields = schema(name)
    return spark.createDataFrame([[r.get(f.name) for f in fields] for r in rows], fields)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    sites = [
        {"siteID": i + 1, "storeNumber": c, "siteName": f"Site {i + 1}", "region": f"R{i % 2}",
         "district": f"D{i % 3}"}
        for i, c in enumerate(CODES)
    ]
    fleets = [
        {"fleetID": i, "fleetCode": f"MBL-{i}", "fleetAccountNumber": i, "fleetAccountName": f"Fleet {i}"}
        for i in range(1, 5)
    ]
    customers = [
        {"customerID": 1, "customerCompanyName": "P1", "corpType": "T5C",
         "aiInvoiceFlatFee": Decimal("1.50")},
        {"customerID": 2, "customerCompanyName": "P2", "corpType": "MBL",
         "aiInvoicePctFee": Decimal("0.01")},
        {"customerID": 3, "customerCompanyName": "P3", "corpType": "XXX"},
    ]
    brands = [
        {"corporationType": "T5C", "aiFeePct": Decimal("0.02")},
        {"corporationType": "MBL", "aiFeePct": Decimal("0.03")},
    ]
    invoices = [
        {
            "invoiceID": n // 2, "customerID": rng.choice([1, 2, 3]), "fleetID": rng.choice([1, 2, 3, 9, 1]),
            "siteID": rng.choice([1, 2, 3, 4, 5, 99]),
            "invoiceDate": datetime.combine(
                START + timedelta(days=rng.randrange(30)), time(rng.randrange(24))
            ),
            "invoiceTotalAmount": Decimal(rng.randrange(0, 20000)) / 100 if rng.random() > 0.1 else None,
            "prepaidTotalAmount": rng.choice([None, Decimal("5.00")]),
            "invoiceTotalDiscounts": Decimal("1.25"), "invoiceInvoiceFee": rng.choice([None, Decimal("2.00")]),
            "voided": rng.choice([0, 0, 1, None]),
        }
        for n in range(400)
    ]
    kpi = [
        {
            "weekEnding": date(2026, 1, 3) + timedelta(days=7 * rng.randrange(5)),
            "fleetAccountNumber": rng.choice([1, 2, 3, None]), "storeNumber": rng.choice([1, 2, 3, None]),
            "fleetAccountName": rng.choice(["A", "B"]), "carsPerDay": rng.randrange(5),
            "grossSales": rng.choice([None, Decimal(rng.randrange(0, 20000)) / 100]),
        }
        for _ in range(60)
    ]
    return {"sites": sites, "fleets": fleets, "customers": customers, "corporation_types": brands,
            "invoices": invoices, "partner_kpi": kpi, "invoice_item_bridge": [
                {"invoiceItemBridgeID": i, "invoiceID": 1000 + i // 3, "serviceCatgCode": f"C{i % 2}",
                 "itemDescription": ["Oil change", "Tire rotation", None][i % 3],
                 "serviceActualQuantity": Decimal(i), "serviceActualAmount": Decimal("3.10") * i}
                for i in range(30)
            ]}


@pytest.fixture(scope="module")
def tables(spark, data):
    return Tables(**{name: table(spark, name, rows) for name, rows in data.items()})


STORE = {1: 1, 2: 2, 3: 1, 4: None, 5: 3}


def saturday(d):
    return d + timedelta(days=(5 - d.weekday()) % 7)


def brute(data, keep=lambda i: i["voided"] in (0, None), keep_kpi=lambda r: True):
    fleets = {f["fleetID"]: f["fleetAccountName"] for f in data["fleets"]}
    booked = defaultdict(list)
    for i in data["invoices"]:
        if keep(i):
            fleet = i["fleetID"] if i["fleetID"] in fleets else None
            booked[saturday(i["invoiceDate"].date()), fleet, STORE.get(i["siteID"])].append(i)
    reported = defaultdict(list)
    for r in data["partner_kpi"]:
        if keep_kpi(r):
            reported[r["weekEnding"], r["fleetAccountNumber"], r["storeNumber"]].append(r)

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    out = []
    pairs = [(k, k if k in reported and None not in k else None) for k in booked]
    taken = {k for _, k in pairs if k}
    pairs += [(None, k) for k in reported if k not in taken]
    for b, r in pairs:
        rows, kpis = booked.get(b, []), reported.get(r, [])
        balance = total(
            None if i["invoiceTotalAmount"] is None
            else i["invoiceTotalAmount"] - (i["prepaidTotalAmount"] or 0) for i in rows
        )
        gross = total(k["grossSales"] for k in kpis)
        diff = (balance or 0) - (gross or 0)
        status = ("missing_mfc" if balance is None else "missing_driven" if gross is None
                  else "matched" if abs(diff) < 1 else "variance")
        out.append((*(b or r), len({i["invoiceID"] for i in rows}) if rows else None, balance,
                    gross, diff, status))
    return sorted(out, key=repr)


def result(weekly):
    rows = weekly.select(
        "weekEnding", "fleetAccountNumber", "storeNumber", "mfcInvoiceCount", "mfcTotalBalance",
        "drivenGrossSales", "variance", "reconStatus",
    ).collect()
    plain = lambda v: v.normalize() + 0 if isinstance(v, Decimal) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def expected(data, **filters):
    plain = lambda v: Decimal(v).normalize() + 0 if isinstance(v, Decimal) else v
    rows = [tuple(plain(Decimal(v) if k in (4, 5, 6) and v is not None else v)
                  for k, v in enumerate(r)) for r in brute(data, **filters)]
    return sorted(rows, key=repr)


def test_weekly_variance_equals_brute_force(tables, data):
    assert result(pipeline.weekly_variance(tables)) == expected(data)


@pytest.mark.parametrize(
    ("bar", "keep", "keep_kpi"),
    [
        (FilterBar(voided="include"), lambda i: True, lambda r: True),
        (FilterBar(voided="only"), lambda i: i["voided"] == 1, lambda r: True),
        (FilterBar(store=1), lambda i: i["voided"] != 1 and STORE.get(i["siteID"]) == 1,
         lambda r: r["storeNumber"] == 1),
        (FilterBar(fleet=2), lambda i: i["voided"] != 1 and i["fleetID"] == 2,
         lambda r: r["fleetAccountNumber"] == 2),
        (FilterBar(region="R0"), lambda i: i["voided"] != 1 and i["siteID"] in (1, 3, 5),
         lambda r: True),
        (FilterBar(district="D1"), lambda i: i["voided"] != 1 and i["siteID"] in (2, 5),
         lambda r: True),
        (FilterBar(start=date(2026, 1, 5), end=date(2026, 1, 17)),
         lambda i: i["voided"] != 1 and date(2026, 1, 5) <= i["invoiceDate"].date() <= date(2026, 1, 17),
         lambda r: date(2026, 1, 5) <= r["weekEnding"] <= date(2026, 1, 17)),
        (FilterBar(search="SITE 2"), lambda i: i["voided"] != 1 and i["siteID"] == 2, lambda r: True),
        (FilterBar(search="fleet 3"), lambda i: i["voided"] != 1 and i["fleetID"] == 3, lambda r: True),
    ],
)
def test_filters_reach_the_right_sides(tables, data, bar, keep, keep_kpi):
    assert result(pipeline.weekly_variance(tables, bar)) == expected(data, keep=keep, keep_kpi=keep_kpi)


def test_unknown_choices_are_rejected(tables):
    with pytest.raises(ValueError):
        FilterBar(voided="maybe").booked(enrich.enrich_core(tables.invoices, tables.fleets, tables.sites))
    with pytest.raises(ValueError):
        reconcile.sort_columns("color")


def test_null_keys_match_nothing(frame):
    ddl = "weekEnding DATE, fleetAccountNumber BIGINT, storeNumber BIGINT, {} DECIMAL(18,2)"
    left = frame([("2026-01-03", 1, None, 5)], ddl.format("a"))
    right = frame([("2026-01-03", 1, None, 5)], ddl.format("b"))
    out = reconcile.reconcile(left, right, reconcile.KEYS, ["a"], ["b"], ("a", "b"))
    assert sorted(r.reconStatus for r in out.collect()) == ["missing_driven", "missing_mfc"]


def test_side_names_flow_through(tables):
    sides = Sides("ours", "theirs")
    weekly = pipeline.weekly_variance(tables, sides=sides)
    assert {"oursTotalBalance", "theirsGrossSales"} <= set(weekly.columns)
    seen = {r.reconStatus for r in reconcile.variance_summary(weekly, sides).collect()}
    assert seen <= set(sides.statuses()) and "missing_theirs" in seen


@pytest.fixture(scope="module")
def weekly(tables):
    return pipeline.weekly_variance(tables).cache()


def test_summary_adds_up(weekly):
    summary = reconcile.variance_summary(weekly).collect()
    assert sum(r.rows for r in summary) == weekly.count()
    assert sum(r.netVariance for r in summary) == sum(r.mfcTotal for r in summary) - sum(
        r.drivenTotal for r in summary
    )
    totals = reconcile.totals_row(weekly).first()
    assert totals.mfcTotalBalance == sum(r.mfcTotal for r in summary)
    assert totals.variancePct is None


def test_rollups_count_distinct_pairs(weekly):
    rows = weekly.filter("reconStatus = 'variance'")
    for made, other, touched, keys in (
        (reconcile.variance_by_store(weekly), "fleetAccountNumber", "fleetWeeksTouched",
         ["storeNumber", "siteName"]),
        (reconcile.variance_by_fleet(weekly), "storeNumber", "storeWeeksTouched",
         ["fleetAccountNumber", "fleetName"]),
    ):
        pair = F.concat(F.col("weekEnding").cast("string"), F.lit("|"), F.col(other))
        want = rows.groupBy(*keys).agg(F.count_distinct(pair).alias("n")).collect()
        got = made.select(*keys, touched).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
        assert made.agg(F.sum("netVariance")).first()[0] == rows.agg(F.sum("variance")).first()[0]


def test_top_and_pages_are_ordered(weekly):
    top = [abs(r.variance) for r in reconcile.top_variances(weekly, 5).collect()]
    every = sorted((abs(r.variance) for r in weekly.filter("reconStatus = 'variance'").collect()), reverse=True)
    assert top == every[:5]
    page = [r.weekEnding for r in reconcile.display_page(weekly, "weekEnding", 10).collect()]
    assert page == sorted(page, reverse=True)
    signed = [r.variance for r in reconcile.display_page(weekly, "variance", 10).collect()]
    assert signed == sorted(signed, reverse=True)


def test_no_kpi_means_everything_is_missing_there(spark, tables):
    from dataclasses import replace

    bare = replace(tables, partner_kpi=stub(spark, "partner_kpi"))
    seen = {r.reconStatus for r in pipeline.weekly_variance(bare).collect()}
    assert seen <= {"missing_driven", "missing_mfc"}  # the latter: all balances of a group NULL


def test_date_filter_reaches_timestamps_and_dates(frame):
    df = frame([("2026-01-31 23:59:59",), ("2026-02-01 00:00:00",)], "t TIMESTAMP")
    tests = between_days(F.col("t"), date(2026, 1, 1), date(2026, 1, 31))
    assert df.filter(tests[0] & tests[1]).count() == 1


def test_month_rollup_adds_up(tables, data):
    enriched = enrich.invoice_enriched(
        tables.invoices, tables.fleets, tables.sites, tables.customers, tables.corporation_types
    )
    assert enriched.count() == len(data["invoices"])
    month = rollups.fleet_store_month(enriched)
    got = month.agg(F.sum("totalInvoice"), F.sum("totalMfcFee"), F.sum("totalAiFee")).first()
    rates = {1: (Decimal("1.50"), Decimal("0.02")), 2: (0, Decimal("0.01")), 3: (0, 0)}
    totals = [i for i in data["invoices"] if i["invoiceTotalAmount"] is not None]
    assert got[0] == sum(i["invoiceTotalAmount"] for i in totals)
    assert got[1] == sum(i["invoiceInvoiceFee"] or 0 for i in data["invoices"])
    assert got[2] == sum(rates[i["customerID"]][0] + i["invoiceTotalAmount"] * rates[i["customerID"]][1]
                         for i in totals)


def test_names_are_the_greatest_of_their_group(spark, tables, data):
    """Two sites share a store number, two fleets an account number; some have no name."""
    fleets = data["fleets"] + [
        {"fleetID": 7, "fleetCode": "X", "fleetAccountNumber": 1, "fleetAccountName": "Fleet 0"},
        {"fleetID": 8, "fleetCode": "Y", "fleetAccountNumber": None, "fleetAccountName": "No number"},
        {"fleetID": 10, "fleetCode": "Z", "fleetAccountNumber": 2, "fleetAccountName": None},
    ]
    sites = [s | ({"siteName": None} if s["siteID"] == 2 else {}) for s in data["sites"]]
    invoices = [i | {"fleetID": [1, 7, 8, 10, 2, 9][n % 6]} for n, i in enumerate(data["invoices"])]
    t = replace(tables, fleets=table(spark, "fleets", fleets), sites=table(spark, "sites", sites),
                invoices=table(spark, "invoices", invoices))
    fleet, site = {f["fleetID"]: f for f in fleets}, {s["siteID"]: s["siteName"] for s in sites}
    want = defaultdict(lambda: [set(), set(), set()])
    for i in invoices:
        if i["voided"] in (0, None):
            f = fleet.get(i["fleetID"], {})
            key = saturday(i["invoiceDate"].date()), f.get("fleetAccountNumber"), STORE.get(i["siteID"])
            want[key][0].add(f.get("fleetAccountName"))
            want[key][1].add(site.get(i["siteID"]))
    for r in data["partner_kpi"]:
        key = r["weekEnding"], r["fleetAccountNumber"], r["storeNumber"]
        # A key with a NULL matches nothing, so its two sides are two rows.
        want[key if None not in key else (*key, "reported")][2].add(r["fleetAccountName"])

    def top(*sets):
        found = [max(s - {None}) for s in sets if s - {None}]
        return found[0] if found else "<unknown>"

    rows = [(*k[:3], top(a, c), top(b)) for k, (a, b, c) in want.items()]
    got = pipeline.weekly_variance(t).select(*reconcile.KEYS, "fleetName", "siteName").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_duplicate_brand_multiplies_rows(tables):
    twice = tables.corporation_types.unionByName(tables.corporation_types)
    core = enrich.enrich_core(tables.invoices, tables.fleets, tables.sites)
    once = enrich.enrich_fees(core, tables.customers, tables.corporation_types).count()
    known = tables.invoices.filter("customerID IN (1, 2)").count()
    assert enrich.enrich_fees(core, tables.customers, twice).count() == once + known


def test_scoping(tables, data):
    as_of = date(2026, 4, 10)
    extracts = pipeline.scoped(tables, as_of)
    assert {r.corpType for r in extracts.customers.collect()} == {"T5C", "MBL"}
    assert extracts.sites.count() == len(CODES)
    kept = [i for i in data["invoices"] if i["customerID"] in (1, 2)]
    assert extracts.invoices.count() == len(kept)
    assert extracts.invoices.columns == tables.invoices.columns
    live = {i["fleetID"] for i in kept if i["voided"] == 0}
    assert {r.fleetID for r in extracts.fleets.collect()} == live & {1, 2, 3, 4}
    assert pipeline.scoped(tables, date(2026, 5, 1)).invoices.count() == 0
    january = tables.invoices.filter(scope.in_window(F.col("invoiceDate"), date(2026, 4, 30)))
    assert january.count() == len(data["invoices"])


def test_extract_leaves_no_intermediate_table(spark, tables, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    listed = lambda: {f for f in os.listdir(shared) if f.startswith("scoped_invoices")} if os.path.isdir(shared) else set()
    before, as_of = listed(), date(2026, 4, 10)
    written = pipeline.extract(tables, str(tmp_path / "out"), as_of)
    assert listed() == before and written["invoices"] > 0
    again = spark.read.option("header", True).csv(str(tmp_path / "out/invoices.csv"))
    assert again.count() == written["invoices"] == pipeline.scoped(tables, as_of).invoices.count()


def test_voided_predicates(frame):
    df = frame([(0,), (1,), (None,)], "voided INT")
    assert df.filter(scope.not_voided_strict(F.col("voided"))).count() == 1
    assert df.filter(scope.not_voided_lenient(F.col("voided"))).count() == 2


def test_line_rollups_equal_the_plain_join(spark, tables):
    header = [
        {"invoiceID": 1000 + i, "fleetID": i % 3 + 1, "siteID": i % 6 + 1, "customerID": 1,
         "invoiceDate": datetime(2026, 1 + i % 2, 3)} for i in range(8)
    ]
    invoices = table(spark, "invoices", header)
    lines = tables.invoice_item_bridge
    joined = enrich.line_enriched(lines, enrich.enrich_core(invoices, tables.fleets, tables.sites))
    assert joined.count() == 24
    mix = rollups.store_product_mix(lines, invoices, tables.sites)
    want = joined.groupBy("storeNumber", "siteName", "serviceCatgCode").agg(
        F.sum("serviceActualAmount"), F.count("*"))
    assert sorted(map(tuple, mix.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    products = rollups.product_totals(lines, invoices)
    assert products.agg(F.sum("lineCount")).first()[0] == 24
    services = rollups.service_type_rollup(lines, invoices, tables.fleets, tables.sites)
    assert {r.serviceType for r in services.collect()} == {"Oil change", "Tire service", "Other"}
    assert services.agg(F.sum("revenue")).first()[0] == joined.agg(F.sum("serviceActualAmount")).first()[0]


def test_pipeline_from_csv_to_report(spark, tables, data, tmp_path):
    source, out = str(tmp_path / "extracts"), str(tmp_path / "report")
    written = pipeline.write_extracts(tables, source)
    assert written["invoices"] == len(data["invoices"])
    loaded = pipeline.store_parquet(pipeline.load_csv(spark, source), str(tmp_path / "rest"))
    assert result(pipeline.weekly_variance(loaded)) == expected(data)
    again = pipeline.load_parquet(spark, str(tmp_path / "rest"))
    counts = {r.table_name: r.rows for r in rollups.row_counts(again.as_dict()).collect()}
    assert counts == {name: len(rows) for name, rows in data.items()}
    rows = pipeline.report(loaded, out, status="variance")
    want = [r for r in expected(data) if r[-1] == "variance"]
    assert rows["variance"] == len(want) and rows["totals"] == 1
    exported = spark.read.option("header", True).csv(f"{out}/variance.csv")
    assert exported.count() == len(want)


@pytest.mark.parametrize("rows", ["TRUE", "reconStatus <> 'variance'", "FALSE"])
def test_one_aggregation_gives_the_four_rollups(weekly, rows):
    some = weekly.filter(rows)
    got = reconcile.report_outputs(reconcile.report_sets(some))
    want = {"summary": reconcile.variance_summary(some), "totals": reconcile.totals_row(some),
            "by_store": reconcile.variance_by_store(some), "by_fleet": reconcile.variance_by_fleet(some)}
    assert got.keys() == want.keys()
    for name, df in want.items():
        assert got[name].columns == df.columns
        assert sorted(map(repr, got[name].collect())) == sorted(map(repr, df.collect()))


def test_the_report_reads_the_weekly_table_once_for_all_rollups(spark, weekly, tmp_path):
    weekly.write.parquet(str(tmp_path / "weekly"))
    plan = reconcile.report_sets(spark.read.parquet(str(tmp_path / "weekly")))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def test_registered_views_answer_ad_hoc_sql(spark, tables, weekly):
    names = pipeline.register(tables, weekly)
    assert len([n for n in names if n.startswith("v_")]) == 11
    for name in names:
        spark.sql(f"SELECT * FROM {name} LIMIT 1").collect()
    got = spark.sql(
        "SELECT reconStatus, count(*) FROM v_variance_fleet_store_week GROUP BY 1 ORDER BY 1"
    ).collect()
    want = spark.sql("SELECT reconStatus, rows FROM v_variance_summary").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert pipeline.month_preview(tables, 3).count() == 3
