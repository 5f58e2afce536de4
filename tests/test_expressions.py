"""Golden cases per expression."""

from datetime import date
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosstally.contract import SERVICE_RULES, Sides
from crosstally.functions import casts, dates, keys, labels, money
from crosstally.functions.sums import exact_sum


def one_column(frame, cells, ddl="v STRING"):
    return frame([(i, c) for i, c in enumerate(cells)], f"i INT, {ddl}")


def apply(frame, cells, expression, ddl="v STRING"):
    df = one_column(frame, cells, ddl)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_store_number(frame):
    cases = {
        "T5C12345": 12345, "T5C12345828": 12345, "T5C1828": 1, "T5C828": 828, "T5CX828": None,
        "T5C12A": None, "MBL0042": 42, "T5C12.6": 13, "T5C": None, "": None, None: None,
    }
    assert apply(frame, cases, keys.store_number) == list(cases.values())


def test_account_number(frame):
    cases = {"MBL-100457": 100457, "T5C-1": 1, "AIN-7": 7, "AIC-8": 8, "XYZ-5": None,
             "MBL-12A": None, "MBL-": None, None: None}
    assert apply(frame, cases, keys.account_number) == list(cases.values())


def test_ai_invoice(frame):
    df = frame(
        [(1, "2026-01-01", None), (2, None, "0.50"), (3, None, "0"), (4, None, None)],
        "i INT, d DATE, fee DECIMAL(18,2)",
    )
    flags = df.orderBy("i").select(keys.is_ai_invoice(F.col("d"), F.col("fee"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]


def test_week_ending(frame):
    cases = {"2025-12-28": date(2026, 1, 3), "2026-01-03": date(2026, 1, 3),
             "2026-01-04": date(2026, 1, 10), None: None}
    assert apply(frame, cases, dates.week_ending, "v DATE") == list(cases.values())
    sunday = lambda c: dates.week_ending(c, last_day=1)
    assert apply(frame, ["2026-01-03", "2026-01-04"], sunday, "v DATE") == [date(2026, 1, 4)] * 2


def test_month_arithmetic():
    assert dates.window_start(date(2026, 4, 21)) == date(2026, 1, 1)
    assert dates.window_start(date(2026, 2, 15)) == date(2025, 11, 1)
    assert dates.window_start(date(2026, 12, 31), 0) == date(2026, 12, 1)
    assert dates.months_before(date(2024, 2, 29), 12) == date(2023, 2, 28)
    assert dates.months_before(date(2026, 3, 31), 1) == date(2026, 2, 28)
    assert dates.months_before(date(2001, 8, 1), 12) == date(2000, 8, 1)


def test_iso_date_text(frame):
    cases = {
        "46025": "2026-01-03", "46025.75": "2026-01-03", "2026-01-03": "2026-01-03",
        "2026-01-03 00:00:00": "2026-01-03", "2026-01-03T07:00:00": "2026-01-03",
        "week one": "week one", "2026-99-03": "2026-99-03", None: None,
    }
    assert apply(frame, cases, dates.iso_date_text) == list(cases.values())


def test_integer_casts_match_the_sql_engine(frame):
    cells = ["12", " 12 ", "0012", "12.5", "12.4", "-12.5", "-12.6", "1e3", "+7", "5.", ".5", "",
             "12D", "12f", "12A", "NaN", "Infinity", "2147483647", "2147483648", "1e40", "--1"]
    want = [duckdb.execute("SELECT TRY_CAST(? AS INTEGER)", [c]).fetchall()[0][0] for c in cells]
    assert apply(frame, cells, casts.int_from_text) == want
    numbers = [12.5, 13.5, -12.5, 12.4999, 0.5, 1.5, 2147483646.5, 3e9]
    want = [
        duckdb.execute("SELECT TRY_CAST(CAST(? AS DOUBLE) AS INTEGER)", [n]).fetchall()[0][0]
        for n in numbers
    ]
    assert apply(frame, numbers, casts.int_from_double, "v DOUBLE") == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.decimals(-99999, 99999, places=3), min_size=20, max_size=40))
def test_integer_cast_of_random_decimals(spark, numbers):
    cells = [str(n) for n in numbers]
    df = spark.createDataFrame(list(enumerate(cells)), "i INT, v STRING")
    got = [r[0] for r in df.orderBy("i").select(casts.int_from_text(F.col("v"))).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT TRY_CAST(? AS INTEGER)", [c]).fetchall()[0][0] for c in cells]


def test_int_column_follows_the_declared_type(frame):
    df = frame([("13.5", "13.5", "13")], "t STRING, d DOUBLE, n BIGINT")
    row = df.select(*[casts.int_column(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == (14, 14, 13)
    assert apply(frame, ["12.5"], casts.int_from_double, "v DOUBLE") == [12]


@pytest.mark.parametrize("ddl", ["v STRING", "v BOOLEAN"])
def test_flags(frame, ddl):
    df = one_column(frame, ["true", "false", None], ddl)
    got = [r[0] for r in df.orderBy("i").select(casts.flag_column(df, "v")).collect()]
    assert got == [1, 0, None]


def test_flags_from_text_digits(frame):
    df = one_column(frame, ["1", "0", "maybe"])
    assert [r[0] for r in df.orderBy("i").select(casts.flag_column(df, "v")).collect()] == [1, 0, None]


def test_net_balance(frame):
    df = frame([(1, 100, 30), (2, 100, None), (3, None, 30)], "i INT, t DECIMAL(18,2), p DECIMAL(18,2)")
    got = df.orderBy("i").select(money.net_balance(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in got] == [70, 100, None]


def test_cascading_fee(frame):
    rows = [
        (1, 100, None, None, None, "0"), (2, 100, "1.50", None, "0.02", "3.50"),
        (3, 100, "1.50", "0.01", "0.02", "2.50"), (4, 100, None, "0", "0.02", "0"),
        (5, None, "1.50", "0.01", "0.02", None),
    ]
    df = frame(
        rows,
        "i INT, t DECIMAL(18,2), f DECIMAL(18,2), p DECIMAL(9,6), b DECIMAL(9,6), want DECIMAL(18,2)",
    )
    fee = money.cascading_fee(F.col("t"), F.col("f"), F.col("p"), F.col("b"))
    for r in df.select(fee.alias("got"), "want").collect():
        assert r.got == r.want


def test_status_variance_and_percent(frame):
    rows = [
        ("100.00", "100.99", "matched", "-0.99", -0.99 / 100.99),
        ("101.00", "100.00", "variance", "1.00", 0.01),
        ("100", None, "missing_driven", "100", None),
        (None, "50", "missing_mfc", "-50", -1.0),
        (None, None, "missing_mfc", "0", None),
        ("0.50", "0", "matched", "0.50", None),
        ("10", "-5", "variance", "15", None),
    ]
    df = frame(rows, "b DECIMAL(18,2), r DECIMAL(18,2), s STRING, v DECIMAL(18,2), p DOUBLE")
    b, r = F.col("b"), F.col("r")
    for row in df.select(
        money.recon_status(b, r).alias("status"), "s", money.variance(b, r).alias("diff"), "v",
        money.variance_pct(b, r).alias("pct"), "p",
    ).collect():
        assert row.status == row.s
        assert row.diff == row.v
        assert row.pct is None if row.p is None else abs(row.pct - row.p) < 1e-12


def test_tolerance_and_side_names_are_parameters(frame):
    df = frame([("100", "104"), (None, "1")], "b DECIMAL(18,2), r DECIMAL(18,2)")
    status = money.recon_status(F.col("b"), F.col("r"), Decimal("5.00"), Sides("ours", "theirs"))
    assert sorted(r[0] for r in df.select(status).collect()) == ["matched", "missing_ours"]


def test_invoice_arithmetic(frame):
    df = frame([("19.99", "3", "100.00", "10.00")],
               "u DECIMAL(18,2), q DECIMAL(18,4), s DECIMAL(18,2), d DECIMAL(18,2)")
    tax = money.sales_tax(F.col("s"), F.col("d"))
    row = df.select(money.line_total(F.col("u"), F.col("q")), tax,
                    money.billed_total(F.col("s"), F.col("d"), tax)).first()
    assert tuple(row) == (Decimal("59.97"), Decimal("7.43"), Decimal("97.43"))


def test_service_types(frame):
    cases = {
        "Oil change — synthetic": "Oil change", "Oil change — conventional": "Oil change",
        "Oil filter replacement": "Engine filters", "Engine air filter replacement": "Other",
        "Tire rotation": "Tire service", "Tire rotation + balance": "Tire service",
        "Cabin air filter replacement": "Cabin air filters",
        "Brake pad replacement — front": "Brake service", "Wiper blade replacement": "Wipers",
        "Battery test & replacement": "Battery", "Shop labor — 2hr": "Labor",
        "Coolant flush": "Other", "State inspection": "Other",
        "OIL CHANGE with tire rotation": "Oil change", None: "Other",
    }
    assert apply(frame, cases, labels.service_type) == list(cases.values())
    assert [label for label, _ in SERVICE_RULES][0] == "Oil change"


def test_category_wins_over_description(frame):
    df = frame([(1, "Fluids", "Tire"), (2, None, "Tire"), (3, " ", "Tire")],
               "i INT, c STRING, d STRING")
    got = df.orderBy("i").select(labels.service_of_line(F.col("c"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["Fluids", "Tire service", "Tire service"]


def test_exact_sum(frame):
    df = frame([("0.10",)] * 3 + [("9999999999999999.99",), (None,)], "v DECIMAL(18,2)")
    assert df.agg(exact_sum(df, "v")).first()[0] == Decimal("10000000000000000.29")
    fine = frame([("0.001",)] * 3, "v DECIMAL(24,6)")
    assert fine.agg(exact_sum(fine, "v")).first()[0] == Decimal("0.003")
    empty = frame([(None,)], "v DECIMAL(18,2)")
    assert empty.agg(exact_sum(empty, "v")).first()[0] is None
