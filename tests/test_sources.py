"""Readers and writers on temporary folders."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crosstally.contract import KPI_HEADERS, SOURCE_COLUMNS
from crosstally.functions.dates import iso_date_text
from crosstally.operators import scope
from crosstally.plans.pipeline import (
    load_kpi_sheet,
    load_sales,
    register_frames,
    sales_report,
)
from crosstally.schemas import RECONCILIATION_TABLES, REQUIRED, schema
from crosstally.sources import files, sheets, sinks, tables


def test_csv_round_trip_keeps_quotes_and_line_breaks(spark, frame, tmp_path):
    text = 'a "q" b\nsecond, line'
    rows = {"1": text, "2": None, "3": " a ", "4": "\tb", "5": '"', " 6": "c\\"}
    df = spark.createDataFrame(list(rows.items()), "invoice_id STRING, description STRING")
    assert sinks.write_csv(df, str(tmp_path / "out.csv")) == 6
    back = tables.read_text_csv(spark, str(tmp_path / "out.csv"))
    assert {r.invoice_id: r.description for r in back.collect()} == rows


HEADS = {
    "a": "account_id,account_name,segment,status,cancelled_date\n1,One,S,Active,\n",
    "b": "\ufeffaccount_name,account_id,segment,status,cancelled_date\r\nTwo,2,T,Active,\r\n",
    "c": "account_id,account_name,status,cancelled_date\n3,Three,Cancelled,04/21/2026\n",
    "d": "extra,account_id,account_name\nx,4,Four\n",
}


@pytest.mark.parametrize("order", ["abcd", "dcba", "bdac"])
def test_files_with_different_headers_are_matched_by_name(spark, tmp_path, order):
    for i, k in enumerate(order):
        (tmp_path / f"client_{i}.csv").write_text(HEADS[k], encoding="utf-8")
    df = files.read_routed(spark, str(tmp_path))["accounts"]
    assert df.schema == schema("accounts")
    got = {(r.account_id, r.account_name, r.segment, r.status, r.cancelled_date) for r in df.collect()}
    assert got == {
        ("1", "One", "S", "Active", None), ("2", "Two", "T", "Active", None),
        ("3", "Three", None, "Cancelled", date(2026, 4, 21)), ("4", "Four", None, None, None),
    }


def test_a_minimal_drop_folder_loads(spark, tmp_path):
    (tmp_path / "header.csv").write_text(
        "invoice_id,account_id,invoice_date,subtotal,discount_amount,tax_amount,total_amount\n"
        "1,9,01/31/2026,10.00,0,0.80,10.80\n2,9,2026-02-01,5,0,0,5\n"
    )
    (tmp_path / "detail.csv").write_text("invoice_id,line_amount\n1,10.00\n")
    (tmp_path / "accounts.csv").write_text("account_id,account_name\n9,Nine\n")
    got = files.read_routed(spark, str(tmp_path))
    assert {r.invoice_date for r in got["invoice_header"].collect()} == {date(2026, 1, 31), date(2026, 2, 1)}
    assert got["invoice_detail"].first().category is None
    (tmp_path / "detail.csv").write_text("invoice_id,quantity\n1,1\n")
    with pytest.raises(ValueError, match="line_amount"):
        files.read_routed(spark, str(tmp_path))


def test_sales_report_from_a_drop_folder(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    with pytest.raises(FileNotFoundError):
        load_sales(spark, str(drop))
    (drop / "header.csv").write_text(
        "invoice_id,account_id,invoice_date,subtotal,discount_amount,tax_amount,total_amount\n"
        "1,9,01/31/2026,10.00,0,0.80,10.80\n2,8,2025-02-01,5,0,0,5\n"
    )
    tiers = (("Large", 10), ("Small", 0))
    got = sales_report(load_sales(spark, str(drop)), str(tmp_path / "out"), date(2026, 2, 1), tiers)
    assert got["q2_years"] == 2 and got["q5_services"] == "needs invoice_detail"
    assert got["q10_lost_revenue"] == "needs accounts" and got["q1_monthly"] == 2
    (drop / "clients.csv").write_text("account_id,account_name,cancelled_date\n9,Nine,02/28/2026\n8,Eight,\n")
    (drop / "detail.csv").write_text("invoice_id,line_amount\n1,10.00\n")
    got = sales_report(load_sales(spark, str(drop)), str(tmp_path / "out"), date(2026, 2, 1), tiers)
    assert not [x for x in got.values() if isinstance(x, str)]
    lost = tables.read_text_csv(spark, str(tmp_path / "out/q10_lost_revenue.csv")).collect()
    assert [(r.account_id, Decimal(r.lost_revenue)) for r in lost] == [("9", Decimal("10.80"))]


def test_csv_is_split_when_no_text_spans_lines(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 60_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        split = tables.read_text_csv(spark, str(tmp_path / "big.csv"), multi_line=False)
        assert split.rdd.getNumPartitions() > 4 and split.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_dates_of_a_sheet(spark):
    cells = ["04/21/2026", "13/45/2026", "2147483647", "20260103", "46025", "1", "2958465", " 2026-1-3 ", "soon"]
    df = spark.createDataFrame([(c,) for c in cells], "c STRING")
    got = [r[0] for r in df.select(iso_date_text(F.col("c"))).collect()]
    assert got == ["2026-04-21", "13/45/2026", "2147483647", "20260103", "2026-01-03", "1", "9999-12-31", "2026-01-03", "soon"]


def test_a_sheet_needs_only_what_is_compared(spark):
    needed = [h for h, name in KPI_HEADERS.items() if name in REQUIRED["partner_kpi"]]
    sheet = spark.createDataFrame([("1",) * len(needed)], ", ".join(f"c{i} STRING" for i in range(len(needed)))).toDF(*needed)
    row = sheets.typed_kpi(sheet).first()
    assert row.storeNumber == 1 and row.wipers is None
    with pytest.raises(ValueError, match="grossSales"):
        sheets.typed_kpi(sheet.drop("Gross Sales - CY"))


def test_typed_csv_goes_by_header_and_nulls_bad_values(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text(
        "siteName,siteID,storeNumber,siteStreetAddress,siteCityName,siteStateCode,siteZipCode,"
        "sitePhoneNumber,district,division,region,type\n"
        'One,1,T5C0001,,,,01234,,D,,R,\nTwo,two,T5C0002,,,,,,D,,R,\n'
    )
    df = tables.read_csv(spark, str(path), "sites")
    assert df.schema == schema("sites")
    rows = {r.siteName: r for r in df.collect()}
    assert rows["One"].siteID == 1 and rows["One"].siteZipCode == "01234"
    assert rows["Two"].siteID is None


def test_typed_rejects_missing_columns(frame):
    with pytest.raises(ValueError, match="missing columns"):
        tables.typed(frame([(1,)], "siteID STRING"), schema("sites"))


def test_voided_spellings(spark, frame):
    columns = [f.name for f in schema("invoices")]
    for spelled, want in {"True": 1, "False": 0, "1": 1, "0": 0, None: None}.items():
        cells = [None] * (len(columns) - 1) + [spelled]
        df = frame([cells], ", ".join(f"{c} STRING" for c in columns))
        assert tables.typed(df, schema("invoices")).first().voided == want


def test_absent_kpi_is_a_stub(spark, tmp_path):
    df = tables.read_optional_csv(spark, str(tmp_path / "none.csv"), "partner_kpi")
    assert df.schema == schema("partner_kpi")
    assert not tables.has_data(df)
    assert tables.has_data(spark.range(1))


def test_source_projection_has_the_published_columns(spark):
    sizes = {"corporation_types": 13, "customers": 18, "sites": 12, "fleets": 12, "invoices": 16,
             "invoice_item_bridge": 16}
    for table, names in SOURCE_COLUMNS.items():
        raw = spark.createDataFrame([], ", ".join(f"`{n}` STRING" for n in names))
        renamed = tables.rename_source(raw, table)
        assert renamed.columns == [f.name for f in schema(table)]
        assert len(renamed.columns) == sizes[table]
    assert set(sizes) | {"partner_kpi"} == set(RECONCILIATION_TABLES)


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", "invoices", {"user": "u"})
    assert plain == {"url": "jdbc:x", "dbtable": "Invoice", "fetchsize": "5000", "user": "u"}


@pytest.mark.parametrize(
    "keys",
    [
        list(range(1000)),
        [1] * 700 + list(range(2, 302)),  # a key that fills several parts
        [None] * 5 + [3, 3, 3],
        [],
        [10**17 + i for i in range(40)],
        ["o'clock", "a", "b"] * 9,
        [f"2026-01-{1 + i % 28:02}" for i in range(60)],
    ],
)
def test_split_points_are_quantiles_that_the_database_gives(keys):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    kind = "VARCHAR" if any(isinstance(k, str) for k in keys) else "BIGINT"
    con.execute(f"CREATE TABLE Invoice AS SELECT CAST(NULL AS {kind}) AS InvoiceID, 0 AS n LIMIT 0")
    if keys:
        con.executemany("INSERT INTO Invoice VALUES (?, ?)", [(k, i) for i, k in enumerate(keys)])
    asked = tables.split_query("invoices", "InvoiceID", 8)
    predicates = tables.split_predicates("InvoiceID", [r[0] for r in con.execute(f"SELECT * FROM {asked}").fetchall()])
    parts = [con.execute(f"SELECT n FROM Invoice WHERE {p}").fetchall() for p in predicates]
    assert sorted(n for part in parts for (n,) in part) == list(range(len(keys)))  # every row once
    most = keys.count(None) + max((keys.count(k) for k in set(keys) - {None}), default=0)
    assert len(parts) <= 8 and max(map(len, parts)) <= most + len(keys) / 8 + 1


def test_the_database_scopes_as_the_operators_do(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    invoices = [
        (i, 1 + i % 3, i % 5, f"2026-0{1 + i % 6}-01", i % 4 and (i % 4 - 1)) for i in range(1, 61)
    ]
    rows = {
        "Customer(CustomerID, CorpType)": [(1, "T5C"), (2, "MBL"), (3, "X'Y")],
        "Site(SiteID, Store_Number)": [(1, "T5C1"), (2, "MBL2"), (3, "AIN3")],
        "Fleet(FleetID)": [(i,) for i in range(6)],
        "Invoice(InvoiceID, CustomerID, FleetID, Invoice_Date, voided)": invoices,
        "InvoiceItemBridge(InvoiceItemBridgeID, InvoiceID)": [(i, i // 2) for i in range(130)],
    }
    frames = {}
    for name, values in rows.items():
        columns = name[name.index("(") + 1 : -1]
        marks = ", ".join("?" * len(values[0]))
        con.execute(f"CREATE TABLE {name.split('(')[0]} AS SELECT * FROM (VALUES ({marks})) t({columns}) LIMIT 0", values[0])
        con.executemany(f"INSERT INTO {name.split('(')[0]} VALUES ({marks})", values)
    kinds = {"customers": "customerID INT, corpType STRING", "sites": "siteID INT, storeNumber STRING", "fleets": "fleetID INT",
             "invoices": "invoiceID INT, customerID INT, fleetID INT, invoiceDate STRING, voided INT",
             "invoice_item_bridge": "invoiceItemBridgeID INT, invoiceID INT"}
    for (table, kind), values in zip(kinds.items(), rows.values(), strict=True):
        frames[table] = spark.createDataFrame(values, kind)
    frames["invoices"] = frames["invoices"].withColumn("invoiceDate", F.col("invoiceDate").cast("timestamp"))
    codes, as_of = ["T5C", "X'Y"], date(2026, 6, 15)
    both = frames["invoices"], frames["customers"], as_of, codes
    want = {
        "customers": scope.scope_customers(frames["customers"], codes),
        "sites": scope.scope_sites(frames["sites"], codes),
        "fleets": scope.scope_fleets(frames["fleets"], *both),
        "invoices": scope.scope_invoices(*both),
        "invoice_item_bridge": scope.scope_lines(frames["invoice_item_bridge"], *both),
    }
    for table, df in want.items():
        got = con.execute(f"SELECT * FROM {tables.scoped_select(table, as_of, codes)}").fetchall()
        expected = {r[0] for r in df.collect()}
        assert {r[0] for r in got} == expected and len(got) == len(expected) > 0
    assert tables.scoped_select("corporation_types", as_of) == "CorporationTypes"
    scoped = tables.scoped_select("invoices", as_of, codes)
    assert tables.jdbc_options("jdbc:x", scoped)["dbtable"].startswith("(SELECT * FROM Invoice WHERE ")
    split = con.execute(f"SELECT * FROM {tables.split_query(scoped, 'InvoiceID', 3)}").fetchall()
    assert len(split) == 3



def test_kpi_sheet(spark):
    cells = {
        "date": "2026-01-02 00:00:00", "weekEnding": "46025.75", "fleetAccountNumber": "100457",
        "storeNumber": "12.6", "grossSales": "100.125", "carsPerDay": "3",
    }
    titles = [f" {h} " if h == "Date" else h for h in KPI_HEADERS]
    filled = tuple(cells.get(name) for name in KPI_HEADERS.values())
    blank = (None,) * len(titles)
    plain = ", ".join(f"c{i} STRING" for i in range(len(titles)))
    raw = spark.createDataFrame([filled, blank], plain).toDF(*titles)
    rows = sheets.typed_kpi(raw).collect()
    assert len(rows) == 1
    assert rows[0].date == date(2026, 1, 2) and rows[0].weekEnding == date(2026, 1, 3)
    assert rows[0].fleetAccountNumber == 100457 and rows[0].storeNumber == 13
    assert rows[0].grossSales == Decimal("100.125")


def test_latest_kpi_sheet_is_loaded(spark, tmp_path):
    titles = ",".join(KPI_HEADERS)
    for name, store in (("kpi_a.csv", 1), ("kpi_b.csv", 2)):
        cells = ",".join({"storeNumber": str(store), "weekEnding": "46025"}.get(c, "") for c in KPI_HEADERS.values())
        (tmp_path / name).write_text(f"{titles}\n{cells}\n{',' * (len(KPI_HEADERS) - 1)}\n")
    newest = load_kpi_sheet(spark, str(tmp_path)).collect()
    assert [(r.storeNumber, r.weekEnding) for r in newest] == [(2, date(2026, 1, 3))]
    given = load_kpi_sheet(spark, str(tmp_path), str(tmp_path / "kpi_a.csv")).collect()
    assert [r.storeNumber for r in given] == [1]


def test_unknown_header_fails_the_load(frame):
    with pytest.raises(ValueError, match="Surprise"):
        sheets.rename_headers(frame([(1, 2)], "Region STRING, Surprise STRING"))


def test_file_roles(frame):
    cases = {"invoice_header.csv": "invoice_header", "x_detail.csv": "invoice_detail",
             "clients_2026.csv": "accounts", "Third_PARTY.csv": "accounts",
             "header_detail.csv": "invoice_header", "notes.csv": None}
    df = frame([(i, n) for i, n in enumerate(cases)], "i INT, n STRING")
    got = [r[0] for r in df.orderBy("i").select(files.file_role(F.col("n"))).collect()]
    assert got == list(cases.values())


def test_drop_folder_is_routed_by_name(spark, tmp_path):
    head = "account_id,account_name,parent_account_name,segment,status,signup_date,cancelled_date,cancellation_reason"
    (tmp_path / "clients_a.csv").write_text(f"{head}\n1,One,,,Active,2020-01-01,,\n")
    (tmp_path / "party_b.csv").write_text(f"{head}\n2,Two,One,,Active,bad date,,\n")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    routed = files.read_routed(spark, str(tmp_path))
    assert set(routed) == {"accounts"}
    assert register_frames(routed) == ["accounts"]
    assert spark.sql("SELECT count(*) FROM accounts WHERE parent_account_name IS NULL").first()[0] == 1
    assert {r.account_id: r.signup_date for r in routed["accounts"].collect()} == {
        "1": date(2020, 1, 1), "2": None,
    }


def test_latest_file_is_the_greatest_name(spark, tmp_path):
    for name in ("kpi_2026_02.csv", "kpi_2026_10.csv", "kpi_2026_09.csv"):
        (tmp_path / name).write_text("a\n1\n")
    (tmp_path / "zzz.txt").write_text("x")
    assert files.latest_file(spark, str(tmp_path)).endswith("kpi_2026_10.csv")
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path), "*.parquet")


def test_materialise_uses_the_shared_folder(spark):
    df = sinks.materialise(spark.range(7), "seven")
    assert df.count() == 7
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
