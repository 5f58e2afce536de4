"""Sales questions on a small contract-shaped data set, against brute force."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest

from crosstally.functions.dates import months_before
from crosstally.operators import sales
from crosstally.plans.pipeline import sales_cards
from crosstally.schemas import schema

AS_OF = date(2026, 4, 21)
PARENT = "Union Fleet"


def table(spark, name, rows):
    fields = schema(name)
    return spark.createDataFrame([[r.get(f.name) for f in fields] for r in rows], fields)


@pytest.fixture(scope="module")
def data():
    """A parent with eight children, standalone accounts, cancelled ones, two inactive ones."""
    rng = random.Random(3)
    accounts = [{"account_id": "1", "account_name": PARENT, "segment": "Fleet", "status": "Active"}]
    accounts += [
        {"account_id": str(2 + i), "account_name": f"Child {i}", "parent_account_name": PARENT,
         "segment": "Fleet", "status": "Active"} for i in range(8)
    ]
    accounts += [
        {"account_id": str(10 + i), "account_name": f"Alone {i}", "segment": "Retail", "status": "Active"}
        for i in range(5)
    ]
    for i, (months, reason) in enumerate([(4, "Price"), (7, "Price"), (10, "Moved"), (18, "Quality"), (22, "Sold")]):
        accounts.append({
            "account_id": str(20 + i), "account_name": f"Gone {i}", "segment": "Retail",
            "status": "Cancelled", "cancelled_date": AS_OF - timedelta(days=int(30.4 * months)),
            "cancellation_reason": reason,
        })
    accounts += [{"account_id": str(30 + i), "account_name": f"Quiet {i}", "status": "Active"} for i in range(2)]
    header, detail = [], []
    for n in range(900):
        account = rng.choice(["2", "2", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14",
                              "20", "21", "22", "23", "24", "30", "31", "77"])
        day = date(2023, 1, 1) + timedelta(days=rng.randrange((AS_OF - date(2023, 1, 1)).days + 1))
        gone = next((a.get("cancelled_date") for a in accounts if a["account_id"] == account), None)
        if gone and day > gone:
            continue
        if account in ("30", "31") and day > date(2025, 2, 1):
            continue
        items = [(rng.choice(["Oil change", "Tire rotation", "Flush"]), Decimal(rng.randrange(1000, 9000)) / 100)
                 for _ in range(rng.randrange(1, 4))]
        subtotal = sum(a for _, a in items)
        tax = round(subtotal * Decimal("0.0825"), 2)
        header.append({"invoice_id": str(n), "account_id": account, "invoice_date": day, "subtotal": subtotal,
                       "discount_amount": Decimal("1.00"), "tax_amount": tax,
                       "total_amount": subtotal - 1 + tax})
        detail += [{"invoice_id": str(n), "line_id": str(k), "description": d,
                    "category": "Fluids" if d == "Flush" else None, "line_amount": a}
                   for k, (d, a) in enumerate(items)]
    return {"accounts": accounts, "invoice_header": header, "invoice_detail": detail}


@pytest.fixture(scope="module")
def t(spark, data):
    return {n: table(spark, n, rows).cache() for n, rows in data.items()}


def test_one_parent_organisation(t, data):
    members = {"1"} | {str(2 + i) for i in range(8)}
    want = defaultdict(Decimal)
    for h in data["invoice_header"]:
        if h["account_id"] in members and date(2024, 1, 1) <= h["invoice_date"] <= date(2024, 12, 31):
            want[h["invoice_date"].replace(day=1)] += h["total_amount"]
    got = sales.org_monthly(t["invoice_header"], t["accounts"], PARENT, date(2024, 1, 1), date(2024, 12, 31))
    assert {r.month: r.revenue for r in got.collect()} == want
    one = sales.org_monthly(t["invoice_header"], t["accounts"], "2").collect()
    assert {r.org for r in one} == {PARENT}
    assert sum(r.invoices for r in one) == sum(h["account_id"] == "2" for h in data["invoice_header"])


def test_unknown_and_missing_accounts_show_their_id(t):
    orgs = {r.org for r in sales.org_monthly(t["invoice_header"], t["accounts"]).collect()}
    assert "77" in orgs and PARENT in orgs and "Child 0" not in orgs
    assert "2" in {r.org for r in sales.org_monthly(t["invoice_header"], None).collect()}


def test_services_of_an_organisation(t, data):
    owner = {h["invoice_id"]: h["account_id"] for h in data["invoice_header"]}
    label = {"Oil change": "Oil change", "Tire rotation": "Tire service", "Flush": "Fluids"}
    want = defaultdict(Decimal)
    for d in data["invoice_detail"]:
        if owner[d["invoice_id"]] in {"1"} | {str(2 + i) for i in range(8)}:
            want[label[d["description"]]] += d["line_amount"]
    got = sales.org_services(t["invoice_header"], t["invoice_detail"], t["accounts"], PARENT)
    assert {r.service_type: r.revenue for r in got.collect()} == want


def test_revenue_and_growth(t, data):
    years = defaultdict(Decimal)
    for h in data["invoice_header"]:
        years[h["invoice_date"].year] += h["total_amount"]
    assert {r.year: r.revenue for r in sales.revenue_by_year(t["invoice_header"]).collect()} == years
    growth = {r.year: r.growth_pct for r in sales.yoy_growth(t["invoice_header"]).collect()}
    assert growth[2023] is None
    assert abs(growth[2025] - float(years[2025] / years[2024] - 1)) < 1e-9
    net = sales.revenue_by_year(t["invoice_header"], net=True).collect()
    assert sum(r.revenue for r in net) == sum(h["subtotal"] - 1 for h in data["invoice_header"])


def test_growth_skips_a_missing_year(t):
    gap = t["invoice_header"].filter("year(invoice_date) <> 2024")
    assert {r.year: r.growth_pct for r in sales.yoy_growth(gap).collect()}[2025] is None


def test_seasonality_averages_to_one(t):
    rows = sales.seasonality(t["invoice_header"]).collect()
    assert len(rows) == 12
    weighted = sum(r.seasonal_index * r.months for r in rows) / sum(r.months for r in rows)
    assert abs(weighted - 1) < 1e-9


def test_segments(t):
    fleet = sales.segment_revenue_by_year(t["invoice_header"], t["accounts"], "Fleet").collect()
    split = sales.segment_revenue_by_year(t["invoice_header"], t["accounts"]).collect()
    assert {r.year: r.revenue for r in fleet} == {r.year: r.revenue for r in split if r.segment == "Fleet"}
    assert {r.segment for r in split} == {"Fleet", "Retail", None}


def test_parents_mix_and_tiers(t, data):
    assert [tuple(r) for r in sales.fleets_per_parent(t["accounts"]).collect()] == [(PARENT, 8)]
    mix = sales.service_mix(t["invoice_detail"]).collect()
    assert abs(sum(r.share for r in mix) - 1) < 1e-9
    assert sum(r.lines for r in mix) == len(data["invoice_detail"])
    tiers = (("large", 3000), ("medium", 500), ("small", 0))
    spent = defaultdict(Decimal)
    for h in data["invoice_header"]:
        if months_before(AS_OF, 12) <= h["invoice_date"] <= AS_OF:
            spent[h["account_id"]] += h["total_amount"]
    want = defaultdict(int)
    for a in data["accounts"]:
        v = spent[a["account_id"]]
        want["large" if v >= 3000 else "medium" if v >= 500 else "small"] += 1
    got = sales.size_tiers(t["invoice_header"], t["accounts"], AS_OF, tiers).collect()
    assert {r.tier: r.accounts for r in got} == want


def test_inactive_accounts(t):
    rows = sales.inactive_accounts(t["invoice_header"], t["accounts"], AS_OF).collect()
    assert {"Quiet 0", "Quiet 1", PARENT} == {r.account_name for r in rows}  # the parent bills nothing


def test_cancellations_and_lost_revenue(t, data):
    windows = {r.window_months: r.cancelled for r in sales.cancellations(t["accounts"], AS_OF).collect()}
    assert windows == {12: 3, 24: 5}
    want = {}
    for a in data["accounts"]:
        if gone := a.get("cancelled_date"):
            want[a["account_id"]] = sum(
                (h["total_amount"] for h in data["invoice_header"]
                 if h["account_id"] == a["account_id"] and months_before(gone, 12) <= h["invoice_date"] < gone),
                Decimal(0),
            )
    got = sales.lost_revenue(t["invoice_header"], t["accounts"]).collect()
    assert {r.account_id: r.lost_revenue for r in got} == want
    reasons = sales.cancellation_reasons(t["invoice_header"], t["accounts"]).collect()
    assert {r.cancellation_reason: r.accounts for r in reasons} == {"Price": 2, "Moved": 1, "Quality": 1, "Sold": 1}
    assert sum(r.lost_revenue for r in reasons) == sum(want.values())


CUBE_CARDS = {"q1_monthly", "q2_years", "q2_months", "q2_segments", "q3_growth", "q3_seasonality", "q6_tiers",
              "q7_inactive", "q10_lost_revenue", "q11_reasons"}


@pytest.mark.parametrize("net", [False, True])
def test_the_daily_cube_answers_like_the_headers(spark, t, tmp_path, net):
    """Amounts may be NULL, days may carry a time."""
    from pyspark.sql import functions as F

    odd = t["invoice_header"].withColumns({
        "discount_amount": F.when(F.col("invoice_id").cast("int") % 7 != 0, F.col("discount_amount")),
        "total_amount": F.when(F.col("invoice_id").cast("int") % 5 != 0, F.col("total_amount")),
    })
    loaded = {**t, "invoice_header": odd}
    sales.daily_cube(odd).write.parquet(str(tmp_path / "cube"))
    cube = spark.read.parquet(str(tmp_path / "cube"))
    assert cube.agg(F.sum("invoices")).first()[0] == odd.count() > cube.count()
    tiers = (("L", 5000), ("S", 0))
    plain, stored = (sales_cards(loaded, AS_OF, tiers, net, c) for c in (None, cube))
    for name, card in plain.items():
        other = stored[name]
        value = lambda df: sorted(
            repr([v.normalize() if isinstance(v, Decimal) else v for v in r]) for r in df.collect()
        )
        assert value(other) == value(card) and other.columns == card.columns
        read = {f.rsplit("/", 2)[-2] for f in other.inputFiles()}
        assert (read == {"cube"}) == (name in CUBE_CARDS), name
