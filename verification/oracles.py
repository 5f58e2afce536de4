"""DuckDB SQL for every registered query, on the raw test tables.

Written from the definitions, not from the DataFrame code.  Money is summed as DECIMAL and leaves
as DOUBLE in the last projection; every ordering that decides which rows appear ends in the keys.
"""

from __future__ import annotations

# One row per line item with its order, amounts in money.
FACT = """
fact AS (
  SELECT f.*,
         total - CASE WHEN l_returnflag = 'R' THEN discount ELSE 0 END AS balance,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS voided
  FROM (
    SELECT l.*, o.*,
           CAST(o_orderdate AS DATE) AS day,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CAST(o_orderdate AS DATE) + CAST(6 - date_part('dow', o_orderdate) AS INTEGER) AS week,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))
                AS DECIMAL(18,2)) AS discount,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))
                AS DECIMAL(18,2)) AS tax
    FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  ) f
)"""

FLEET = """
fleet AS (SELECT CASE WHEN c_acctbal < 0 THEN -1 - c_custkey ELSE c_custkey END AS fid,
                 c_custkey AS number, 'MBL-' || c_custkey AS code, c_name AS fname
          FROM customer)"""

SITE = """
site AS (
  SELECT s_suppkey AS sid, s_suppkey AS store, s_name AS sname, r_name AS region,
         n_name AS district, 'Division ' || n_regionkey AS division,
         CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'T5C' WHEN r_name = 'ASIA' THEN 'MBL'
              ELSE 'AIN' END
           || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '828' ELSE '' END AS raw
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

PROVIDER = """
provider AS (
  SELECT n_nationkey AS pid, n_name AS pname, r_name AS brand,
         CASE WHEN n_nationkey % 2 = 0 THEN CAST(1.50 AS DECIMAL(18,2)) END AS flat,
         CASE WHEN n_nationkey % 3 = 0 THEN CAST(0.01 AS DECIMAL(9,6)) END AS pct,
         CASE WHEN r_name <> 'ASIA' THEN CAST(0.02 AS DECIMAL(9,6)) END AS brand_pct
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

KPI = """
kpi AS (
  SELECT week + CASE o_orderpriority WHEN '1-URGENT' THEN 7 ELSE 0 END AS week,
         o_custkey AS fid, l_suppkey AS store, discount,
         CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS oil,
         balance + CASE WHEN l_linenumber = 3 THEN 25 ELSE 0 END AS gross
  FROM fact
)"""


def _weekly(booked: str = "coalesce(voided, 0) = 0", reported: str = "TRUE") -> str:
    """The WITH list that ends in ``weekly``, with one condition per side."""
    return f"""WITH {FACT}, {FLEET}, {SITE}, {KPI},
booked AS (
  SELECT week, fid, store, max(fname) AS fname, max(sname) AS sname,
         count(DISTINCT l_orderkey) AS invoices, sum(total) AS total, sum(balance) AS balance,
         sum(discount) AS discount
  FROM fact LEFT JOIN fleet ON fid = o_custkey LEFT JOIN site ON sid = l_suppkey
  WHERE {booked}
  GROUP BY week, fid, store
),
reported AS (
  SELECT week, fid, store, 'Account ' || fid AS aname, sum(gross) AS gross,
         sum(discount) AS discounts, count(*) AS cars, sum(oil) AS oil
  FROM kpi WHERE {reported}
  GROUP BY week, fid, store
),
compared AS (
  SELECT coalesce(b.week, r.week) AS week, coalesce(b.fid, r.fid) AS fid,
         coalesce(b.fname, r.aname, '<unknown>') AS fname,
         coalesce(b.store, r.store) AS store, coalesce(b.sname, '<unknown>') AS sname,
         b.invoices, b.total, b.balance, b.discount, r.gross, r.discounts, r.cars, r.oil,
         coalesce(b.balance, 0) - coalesce(r.gross, 0) AS diff
  FROM booked b FULL JOIN reported r
    ON b.week = r.week AND b.fid = r.fid AND b.store = r.store
),
weekly AS (
  SELECT *,
         CASE WHEN gross > 0
              THEN (CAST(coalesce(balance, 0) AS DOUBLE) - CAST(gross AS DOUBLE))
                   / CAST(gross AS DOUBLE) END AS pct,
         CASE WHEN balance IS NULL THEN 'missing_mfc' WHEN gross IS NULL THEN 'missing_driven'
              WHEN abs(diff) < 1 THEN 'matched' ELSE 'variance' END AS status
  FROM compared
)"""


WEEKLY_ROW = """
SELECT week AS "weekEnding", fid AS "fleetAccountNumber", store AS "storeNumber",
       fname AS "fleetName", sname AS "siteName", invoices AS "mfcInvoiceCount",
       CAST(total AS DOUBLE) AS "mfcTotalInvoice", CAST(balance AS DOUBLE) AS "mfcTotalBalance",
       CAST(discount AS DOUBLE) AS "mfcTotalDiscount", CAST(gross AS DOUBLE) AS "drivenGrossSales",
       CAST(discounts AS DOUBLE) AS "drivenDiscounts", CAST(cars AS BIGINT) AS "drivenCarsPerDay",
       CAST(oil AS BIGINT) AS "drivenOilChanges", CAST(diff AS DOUBLE) AS variance,
       pct AS "variancePct", status AS "reconStatus"
FROM weekly"""

SUMMARY_ROW = """
SELECT status AS "reconStatus", count(*) AS rows,
       CAST(sum(coalesce(invoices, 0)) AS BIGINT) AS "mfcInvoices",
       CAST(sum(coalesce(balance, 0)) AS DOUBLE) AS "mfcTotal",
       CAST(sum(coalesce(gross, 0)) AS DOUBLE) AS "drivenTotal",
       CAST(sum(diff) AS DOUBLE) AS "netVariance"
FROM weekly GROUP BY status"""

TIES = """week NULLS LAST, fid NULLS LAST, store NULLS LAST, fname NULLS LAST, sname NULLS LAST"""

# Order headers as invoices: one row per order.
ORDER_INVOICE = """
inv AS (
  SELECT o_orderkey AS iid, o_custkey AS fk, o_custkey // 15 AS sk, o_orderkey % 25 AS pk,
         CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS voided
  FROM orders
)"""

ITEM = """
item AS (
  SELECT l_orderkey AS iid, l_orderkey * 10 + l_linenumber AS item_id, p_type AS category,
         p_name AS descr, CAST(l_quantity AS DECIMAL(18,4)) AS qty, amount,
         amount - CAST(amount * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS actual
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem) l
  JOIN part ON l_partkey = p_partkey
)"""


def _part_class(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return f"""CASE WHEN {t} LIKE '%bolt%' THEN 'Fasteners'
    WHEN {t} LIKE '%ring%' OR {t} LIKE '%rod%' THEN 'Rings and rods'
    WHEN {t} LIKE '%gear%' THEN 'Drivetrain'
    WHEN {t} LIKE '%plate%' THEN 'Flat stock'
    WHEN {t} LIKE '%widget%' OR {t} LIKE '%gizmo%' THEN 'Gadgets' ELSE 'Other' END"""


HEADER = """
header AS (
  SELECT invoice_id, account_id, day, total, tax, discount,
         CASE WHEN o_orderstatus = 'P' THEN total - tax ELSE total - tax + discount END AS subtotal
  FROM (
    SELECT o_orderkey AS invoice_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day,
           o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(4,2))
                AS DECIMAL(18,2)) AS tax,
           CASE WHEN o_orderpriority = '1-URGENT'
                THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.02 AS DECIMAL(4,2))
                          AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS discount
    FROM orders
  )
)"""

DETAIL = f"""
detail AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_id,
         CASE WHEN p_size > 25 THEN p_type ELSE {_part_class('p_name')} END AS service,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,4)) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

ACCOUNT = """
account AS (
  SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS segment,
         CASE WHEN c_custkey % 3 = 0 THEN n_name END AS parent,
         CASE WHEN cents % 10 = 0
              THEN DATE '2001-08-01' - CAST((cents // 10) % 24 * 30 AS INTEGER) END AS gone,
         CASE WHEN cents % 10 = 0
              THEN ['price', 'closed', 'service', 'merged'][1 + (cents // 10) % 4] END AS reason
  FROM (SELECT *, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents FROM customer)
  JOIN nation ON c_nationkey = n_nationkey
)"""

LOST = f"""WITH {HEADER}, {ACCOUNT},
lost AS (
  SELECT a.account_id, account_name, gone, reason, coalesce(sum(total), 0) AS lost
  FROM account a LEFT JOIN header h
    ON h.account_id = a.account_id AND day < gone AND day >= gone - INTERVAL 12 MONTH
  WHERE gone IS NOT NULL
  GROUP BY ALL
)"""

TIER = f"""WITH {HEADER}, {ACCOUNT},
spent AS (
  SELECT a.account_id, account_name, coalesce(sum(total), 0) AS revenue
  FROM account a LEFT JOIN header h
    ON h.account_id = a.account_id AND day BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'
  GROUP BY ALL
),
tiers AS (
  SELECT *, CASE WHEN revenue >= 4000000 THEN 'XL' WHEN revenue >= 2500000 THEN 'Large'
                 WHEN revenue >= 1000000 THEN 'Medium' ELSE 'Small' END AS tier
  FROM spent
)"""

DOCUMENT = """
doc AS (
  SELECT d.doc_id || '.metadata' AS file_name, lang <> 'es' AS ok, text,
         CASE WHEN n_chars > 2000 THEN 'FOLDER' ELSE 'DOC' END AS kind,
         coalesce(toxic, 0) = 1 AS deleted,
         CASE WHEN toxic = 1 THEN '(in: trash)' WHEN lang = 'fr' THEN ''
              ELSE '(in: ' || left(source || '-shelf-' || lang, 8) || '...)' END AS place
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def _monthly(where: str = "TRUE") -> str:
    return f"""WITH {HEADER}, {ACCOUNT}
SELECT coalesce(parent, account_name, CAST(h.account_id AS VARCHAR)) AS org,
       CAST(date_trunc('month', day) AS DATE) AS month,
       CAST(sum(total) AS DOUBLE) AS revenue, count(*) AS invoices
FROM header h LEFT JOIN account a ON a.account_id = h.account_id
WHERE {where}
GROUP BY 1, 2"""


ENRICHED = f"""WITH {FACT}, {FLEET}, {SITE}, {PROVIDER},
rich AS (
  SELECT fact.*, fleet.*, site.*, provider.*,
         CASE WHEN l_returnflag <> 'N' THEN l_linenumber ELSE 0 END AS own_fee,
         CASE WHEN l_returnflag = 'A' THEN tax END AS cc,
         coalesce(flat, 0) + total * coalesce(pct, brand_pct, 0) AS ai_fee
  FROM fact LEFT JOIN fleet ON fid = o_custkey LEFT JOIN site ON sid = l_suppkey
            LEFT JOIN provider ON pid = l_suppkey % 25
)"""

MONTH = """
SELECT month AS period, code AS "fleetCode", fname AS "fleetName", store AS "storeNumber",
       sname AS "siteName", count(DISTINCT l_orderkey) AS "invoiceCount",
       CAST(sum(total) AS DOUBLE) AS "totalInvoice", CAST(sum(balance) AS DOUBLE) AS "mfcTotalBalance",
       CAST(sum(tax) AS DOUBLE) AS "totalTax", CAST(sum(discount) AS DOUBLE) AS "totalDiscount",
       CAST(sum(cc) AS DOUBLE) AS "totalCcFee", CAST(sum(own_fee) AS DOUBLE) AS "totalMfcFee",
       CAST(sum(ai_fee) AS DOUBLE) AS "totalAiFee", min(day) AS "firstInvoiceDate",
       max(day) AS "lastInvoiceDate"
FROM rich GROUP BY month, code, fname, store, sname"""

SCOPED = "brand IN ('ASIA', 'EUROPE') AND day >= DATE '2001-05-01'"


def _checks(check: str, ctes: str, subjects: dict[str, str]) -> str:
    """One SELECT per subject; each value is a scalar query for the violations."""
    rows = [
        f"SELECT '{check}' AS check_name, '{name}' AS subject, CAST(({sql}) AS BIGINT) AS violations"
        for name, sql in subjects.items()
    ]
    return (f"WITH {ctes}\n" if ctes else "") + "\nUNION ALL ".join(rows)


def _nulls(table: str, **columns: str) -> dict[str, str]:
    names = {
        "invoice_header": "header", "invoice_detail": "detail", "accounts": "account"
    }
    return {
        f"{table}.{c}": f"SELECT count(*) FROM {names[table]} WHERE {expr} IS NULL"
        for c, expr in columns.items()
    }


ORACLES: dict[str, str] = {
    "variance_fleet_store_week": _weekly() + WEEKLY_ROW,
    "variance_summary": _weekly() + SUMMARY_ROW,
    "top_variances": _weekly() + WEEKLY_ROW
    + f" WHERE status = 'variance' ORDER BY abs(diff) DESC, {TIES} LIMIT 50",
    "variance_by_store": _weekly() + """
SELECT store AS "storeNumber", sname AS "siteName",
       count(DISTINCT week || '|' || fid) AS "fleetWeeksTouched",
       CAST(sum(diff) AS DOUBLE) AS "netVariance", CAST(sum(abs(diff)) AS DOUBLE) AS "absVariance"
FROM weekly WHERE status = 'variance' GROUP BY store, sname""",
    "variance_by_fleet": _weekly() + """
SELECT fid AS "fleetAccountNumber", fname AS "fleetName",
       count(DISTINCT week || '|' || store) AS "storeWeeksTouched",
       CAST(sum(diff) AS DOUBLE) AS "netVariance", CAST(sum(abs(diff)) AS DOUBLE) AS "absVariance"
FROM weekly WHERE status = 'variance' GROUP BY fid, fname""",
    "variance_totals_row": _weekly() + """
SELECT CAST(sum(invoices) AS BIGINT) AS "mfcInvoiceCount",
       CAST(sum(balance) AS DOUBLE) AS "mfcTotalBalance",
       CAST(sum(gross) AS DOUBLE) AS "drivenGrossSales", CAST(sum(diff) AS DOUBLE) AS variance,
       CAST(sum(cars) AS BIGINT) AS "drivenCarsPerDay", CAST(NULL AS DOUBLE) AS "variancePct"
FROM weekly""",
    "variance_report_sets": _weekly() + """
SELECT status AS "reconStatus", store AS "storeNumber", sname AS "siteName",
       fid AS "fleetAccountNumber", fname AS "fleetName",
       CASE WHEN grouping(status) = 0 THEN 'summary' WHEN grouping(store) = 0 THEN 'by_store'
            WHEN grouping(fid) = 0 THEN 'by_fleet' ELSE 'totals' END AS "set",
       count(*) AS rows, count(*) FILTER (status = 'variance') AS "varianceRows",
       CAST(sum(invoices) AS BIGINT) AS "mfcInvoiceCount",
       CAST(sum(balance) AS DOUBLE) AS "mfcTotalBalance",
       CAST(sum(gross) AS DOUBLE) AS "drivenGrossSales", CAST(sum(diff) AS DOUBLE) AS variance,
       CAST(sum(cars) AS BIGINT) AS "drivenCarsPerDay",
       CAST(sum(diff) FILTER (status = 'variance') AS DOUBLE) AS "netVariance",
       CAST(sum(abs(diff)) FILTER (status = 'variance') AS DOUBLE) AS "absVariance"
FROM weekly GROUP BY GROUPING SETS ((status), (store, sname), (fid, fname), ())""",
    "variance_empty_reported": _weekly(reported="FALSE") + SUMMARY_ROW,
    "variance_status_filter": _weekly() + WEEKLY_ROW + " WHERE status = 'variance'",
    "variance_filtered": _weekly(
        "coalesce(voided, 0) = 0 AND region = 'ASIA' "
        "AND day BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'",
        "week BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'",
    ) + WEEKLY_ROW,
    "variance_voided_include": _weekly("TRUE") + SUMMARY_ROW,
    "variance_voided_only": _weekly("voided = 1") + SUMMARY_ROW,
    "variance_search": _weekly(
        "coalesce(voided, 0) = 0 AND (contains(CAST(fid AS VARCHAR), 'supplier#00000001') "
        "OR contains(lower(fname), 'supplier#00000001') "
        "OR contains(CAST(store AS VARCHAR), 'supplier#00000001') "
        "OR contains(lower(sname), 'supplier#00000001'))"
    ) + WEEKLY_ROW,
    "variance_sorted_page": _weekly() + WEEKLY_ROW
    + f" ORDER BY abs(diff) DESC NULLS LAST, {TIES} LIMIT 1000",
    "variance_sorted_by_gross": _weekly() + WEEKLY_ROW
    + f" ORDER BY gross DESC NULLS LAST, {TIES} LIMIT 1000",
    "store_number_parse": f"""WITH {SITE}
SELECT sid AS "siteID", raw AS "rawStore", store AS "storeNumber" FROM site""",
    "account_number_from_code": f"""WITH {FLEET}
SELECT fid AS "fleetID", code AS "fleetCode", number AS "accountNumber" FROM fleet""",
    "ai_invoice_flag": f"""WITH {FACT}
SELECT (l_returnflag = 'N' OR (l_returnflag = 'R' AND discount > 0)) AS "isAiInvoice",
       count(*) AS "invoiceRows", CAST(sum(total) AS DOUBLE) AS "totalInvoice"
FROM fact GROUP BY 1""",
    "ai_fee_cascade": ENRICHED + """
SELECT CAST(pid AS BIGINT) AS "customerID", pname AS "customerName", brand AS "corpType",
       count(*) AS "invoiceRows", CAST(sum(own_fee) AS DOUBLE) AS "totalMfcFee",
       CAST(sum(ai_fee) AS DOUBLE) AS "totalAiFee"
FROM rich GROUP BY pid, pname, brand""",
    "invoice_enriched": ENRICHED + """
SELECT l_orderkey AS "invoiceID", 'INV-' || l_orderkey AS "invoiceNumber", day AS "invoiceDate",
       month AS period, fid AS "fleetID", code AS "fleetCode", fid AS "fleetAccountNumber",
       fname AS "fleetName", sid AS "siteID", store AS "storeNumber", sname AS "siteName", region,
       district, division, CAST(pid AS BIGINT) AS "customerID", pname AS "customerName",
       brand AS "corpType", CAST(total AS DOUBLE) AS "invoiceTotalAmount",
       CAST(CASE WHEN l_returnflag = 'R' THEN discount END AS DOUBLE) AS "prepaidTotalAmount",
       CAST(balance AS DOUBLE) AS "mfcBalance", CAST(tax AS DOUBLE) AS "invoiceTaxTotalAmount",
       CAST(discount AS DOUBLE) AS "invoiceTotalDiscounts", CAST(cc AS DOUBLE) AS "invoiceCCFees",
       CAST(own_fee AS DOUBLE) AS "totalMfcFee", CAST(ai_fee AS DOUBLE) AS "totalAiFee", voided
FROM rich""",
    "fleet_store_month": ENRICHED + MONTH,
    "fleet_store_month_preview": ENRICHED + MONTH + """
ORDER BY month DESC NULLS LAST, fname NULLS LAST, store NULLS LAST, code NULLS LAST,
         sname NULLS LAST LIMIT 50""",
    "line_enriched": f"""WITH {ORDER_INVOICE}, {ITEM}, {FLEET}, {SITE}
SELECT item_id AS "invoiceItemBridgeID", item.iid AS "invoiceID", category AS "serviceCatgCode",
       descr AS "itemDescription", CAST(qty AS DOUBLE) AS "serviceActualQuantity",
       CAST(amount AS DOUBLE) AS "serviceAmount", CAST(actual AS DOUBLE) AS "serviceActualAmount",
       month AS period, code AS "fleetCode", fname AS "fleetName", store AS "storeNumber",
       sname AS "siteName"
FROM item JOIN inv ON inv.iid = item.iid LEFT JOIN fleet ON fid = fk LEFT JOIN site ON sid = sk""",
    "product_totals": f"""WITH {ORDER_INVOICE}, {ITEM}
SELECT category AS "serviceCatgCode", descr AS "itemDescription", count(*) AS "lineCount",
       CAST(sum(qty) AS DOUBLE) AS "totalQuantity", CAST(sum(actual) AS DOUBLE) AS "totalRevenue"
FROM item JOIN inv ON inv.iid = item.iid GROUP BY category, descr""",
    "store_product_mix": f"""WITH {ORDER_INVOICE}, {ITEM}, {SITE}
SELECT store AS "storeNumber", sname AS "siteName", category AS "serviceCatgCode",
       CAST(sum(actual) AS DOUBLE) AS revenue, count(*) AS lines
FROM item JOIN inv ON inv.iid = item.iid LEFT JOIN site ON sid = sk
GROUP BY store, sname, category""",
    "service_type_rollup": f"""WITH {ORDER_INVOICE}, {ITEM}, {FLEET}, {SITE}
SELECT month AS period, code AS "fleetCode", store AS "storeNumber",
       {_part_class('descr')} AS "serviceType",
       CAST(sum(actual) AS DOUBLE) AS revenue, count(*) AS lines
FROM item JOIN inv ON inv.iid = item.iid LEFT JOIN fleet ON fid = fk LEFT JOIN site ON sid = sk
GROUP BY 1, 2, 3, 4""",
    "scope_customers": f"""WITH {PROVIDER}
SELECT CAST(pid AS BIGINT) AS "customerID", pname AS "customerCompanyName", brand AS "corpType",
       CAST(flat AS DOUBLE) AS "aiInvoiceFlatFee", CAST(pct AS DOUBLE) AS "aiInvoicePctFee"
FROM provider WHERE brand IN ('ASIA', 'EUROPE')""",
    "scope_sites": f"""WITH {SITE}
SELECT sid AS "siteID", raw AS "storeNumber", sname AS "siteName", region, district, division
FROM site WHERE raw LIKE 'T5C%' OR raw LIKE 'MBL%'""",
    "scope_fleets_semi": f"""WITH {ORDER_INVOICE}, {FLEET}, {PROVIDER}
SELECT fid AS "fleetID", code AS "fleetCode", number AS "fleetAccountNumber",
       fname AS "fleetAccountName"
FROM fleet WHERE fid IN (SELECT fk FROM inv JOIN provider ON pid = pk
                         WHERE {SCOPED} AND voided = 0)""",
    "scope_invoices": ENRICHED + f"""
SELECT l_orderkey AS "invoiceID", 'INV-' || l_orderkey AS "invoiceNumber",
       l_suppkey % 25 AS "customerID", o_custkey AS "fleetID", l_suppkey AS "siteID",
       day AS "invoiceDate", CAST(total AS DOUBLE) AS "invoiceTotalAmount",
       CAST(tax AS DOUBLE) AS "invoiceTaxTotalAmount",
       CAST(CASE WHEN l_returnflag = 'R' THEN discount END AS DOUBLE) AS "prepaidTotalAmount",
       CAST(discount AS DOUBLE) AS "invoiceTotalDiscounts", CAST(cc AS DOUBLE) AS "invoiceCCFees",
       CAST(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS DOUBLE) AS "invoiceInvoiceFee",
       CASE WHEN l_returnflag = 'N' THEN CAST(l_shipdate AS DATE) END
         AS "invoiceBilledOutOnAutoIntegrate",
       CAST(CASE WHEN l_returnflag = 'R' THEN discount END AS DOUBLE)
         AS "invoiceBillingFeesAutoIntegrate",
       voided
FROM rich WHERE {SCOPED}""",
    "scope_lines": f"""WITH {ORDER_INVOICE}, {ITEM}, {PROVIDER}
SELECT item_id AS "invoiceItemBridgeID", item.iid AS "invoiceID", category AS "serviceCatgCode",
       descr AS "itemDescription", CAST(qty AS DOUBLE) AS "serviceActualQuantity",
       CAST(amount AS DOUBLE) AS "serviceAmount", CAST(actual AS DOUBLE) AS "serviceActualAmount"
FROM item JOIN inv ON inv.iid = item.iid JOIN provider ON pid = pk WHERE {SCOPED} AND voided = 0""",
    "load_row_counts": "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    ),
    "kpi_normalise": f"""WITH {FACT}
SELECT strftime(week, '%Y/%m') AS "yearMonth", week AS date, l_suppkey AS "storeNumber",
       week AS "weekEnding", CAST(count(*) + 1 AS INTEGER) AS "carsPerDay",
       CAST(sum(total) AS DOUBLE) AS "grossSales"
FROM fact GROUP BY week, l_suppkey""",
    "q1_org_monthly": _monthly(),
    "q1_one_org_monthly": _monthly(
        "(parent = 'NATION_7' OR (parent IS NULL AND account_name = 'NATION_7')) "
        "AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
    ),
    "q1_without_accounts": f"""WITH {HEADER}
SELECT CAST(account_id AS VARCHAR) AS org, CAST(date_trunc('month', day) AS DATE) AS month,
       CAST(sum(total) AS DOUBLE) AS revenue, count(*) AS invoices
FROM header GROUP BY 1, 2""",
    "q1_org_services": f"""WITH {HEADER}, {DETAIL}, {ACCOUNT}
SELECT coalesce(parent, account_name, CAST(h.account_id AS VARCHAR)) AS org,
       service AS service_type, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS lines
FROM detail d JOIN header h ON h.invoice_id = d.invoice_id
LEFT JOIN account a ON a.account_id = h.account_id
GROUP BY 1, 2""",
    "sales_daily_cube": f"""WITH {HEADER}
SELECT account_id, day, CAST(sum(total) AS DOUBLE) AS billed,
       CAST(sum(subtotal - discount) AS DOUBLE) AS net, count(*) AS invoices
FROM header GROUP BY account_id, day""",
    "q2_revenue_by_year": f"""WITH {HEADER}
SELECT CAST(year(day) AS INTEGER) AS year, CAST(sum(total) AS DOUBLE) AS revenue,
       count(*) AS invoices FROM header GROUP BY 1""",
    "q2_revenue_by_month": f"""WITH {HEADER}
SELECT CAST(date_trunc('month', day) AS DATE) AS month,
       CAST(sum(subtotal - discount) AS DOUBLE) AS revenue, count(*) AS invoices
FROM header GROUP BY 1""",
    "q2_segment_revenue_by_year": f"""WITH {HEADER}, {ACCOUNT}
SELECT segment, CAST(year(day) AS INTEGER) AS year, CAST(sum(total) AS DOUBLE) AS revenue,
       count(*) AS invoices
FROM header h LEFT JOIN account a ON a.account_id = h.account_id GROUP BY 1, 2""",
    "q3_yoy_growth": f"""WITH {HEADER},
y AS (SELECT CAST(year(day) AS INTEGER) AS year, CAST(sum(total) AS DOUBLE) AS revenue
      FROM header GROUP BY 1)
SELECT a.year, a.revenue, b.revenue AS previous_revenue,
       CASE WHEN b.revenue > 0 THEN (a.revenue - b.revenue) / b.revenue END AS growth_pct
FROM y a LEFT JOIN y b ON b.year = a.year - 1""",
    "q3_seasonality": f"""WITH {HEADER},
m AS (SELECT date_trunc('month', day) AS month, sum(total) AS revenue FROM header GROUP BY 1),
c AS (SELECT CAST(month(month) AS INTEGER) AS month_of_year, count(*) AS months,
             CAST(sum(revenue) AS DOUBLE) / count(*) AS mean_revenue FROM m GROUP BY 1)
SELECT month_of_year, months, mean_revenue,
       mean_revenue / (SELECT CAST(sum(revenue) AS DOUBLE) / count(*) FROM m) AS seasonal_index
FROM c""",
    "q4_fleets_per_parent": f"""WITH {ACCOUNT}
SELECT parent AS parent_account_name, count(*) AS fleets
FROM account WHERE parent IS NOT NULL GROUP BY 1""",
    "q5_service_mix": f"""WITH {DETAIL}
SELECT service AS service_type, CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS lines,
       CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM detail) AS share
FROM detail GROUP BY 1""",
    "q6_account_tiers": TIER + """
SELECT account_id, account_name, CAST(revenue AS DOUBLE) AS revenue, tier FROM tiers""",
    "q6_size_tiers": TIER + """
SELECT tier, count(*) AS accounts, CAST(sum(revenue) AS DOUBLE) AS revenue FROM tiers GROUP BY 1""",
    "q7_inactive": f"""WITH {HEADER}, {ACCOUNT}
SELECT account_id, account_name FROM account a
WHERE gone IS NULL AND NOT EXISTS (
  SELECT 1 FROM header h WHERE h.account_id = a.account_id
    AND day BETWEEN DATE '2000-08-01' AND DATE '2001-08-01')""",
    "q9_cancellations": f"""WITH {ACCOUNT}
SELECT CAST(w AS INTEGER) AS window_months, count(*) AS cancelled
FROM account JOIN (VALUES (12, DATE '2000-08-01'), (24, DATE '1999-08-01')) v(w, since)
  ON gone BETWEEN since AND DATE '2001-08-01'
GROUP BY 1""",
    "q10_lost_revenue": LOST + """
SELECT account_id, account_name, gone AS cancelled_date, reason AS cancellation_reason,
       CAST(lost AS DOUBLE) AS lost_revenue FROM lost""",
    "q11_reasons": LOST + """
SELECT reason AS cancellation_reason, count(*) AS accounts, CAST(sum(lost) AS DOUBLE) AS lost_revenue
FROM lost GROUP BY 1""",
    "dq_required_nulls": _checks(
        "required_nulls", f"{HEADER}, {DETAIL}, {ACCOUNT}",
        _nulls("invoice_header", invoice_id="invoice_id", account_id="account_id",
               invoice_date="day", subtotal="subtotal", discount_amount="discount",
               tax_amount="tax", total_amount="total")
        | _nulls("invoice_detail", invoice_id="invoice_id", line_amount="amount")
        | _nulls("accounts", account_id="account_id", account_name="account_name",
                 parent_account_name="parent"),
    ),
    "dq_duplicate_keys": _checks("duplicate_keys", "", {
        "invoice_header(invoice_id)":
            "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)",
        "invoice_detail(invoice_id, line_id)":
            "SELECT count(*) FROM (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey "
            "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    }),
    "dq_total_arithmetic": _checks("total_arithmetic", HEADER, {
        "invoice_header":
            "SELECT count(*) FROM header WHERE abs(total - (subtotal - discount + tax)) > 0.005",
    }),
    "dq_subtotal_vs_lines": _checks(
        "subtotal_vs_lines",
        f"""{HEADER}, {DETAIL},
sums AS (SELECT h.invoice_id, any_value(subtotal) AS subtotal, sum(amount) AS line_sum
         FROM header h LEFT JOIN detail d ON d.invoice_id = h.invoice_id GROUP BY 1)""",
        {
            "invoice_header.subtotal":
                "SELECT count(*) FROM sums WHERE abs(subtotal - coalesce(line_sum, 0)) > 0.005",
            "invoice_header without lines": "SELECT count(*) FROM sums WHERE line_sum IS NULL",
        },
    ),
    "dq_dimension_fanout": _checks("dimension_fanout", f"{FLEET}, {SITE}, {PROVIDER}", {
        "fleets(fleetID)":
            "SELECT count(*) FROM (SELECT 1 FROM fleet GROUP BY fid HAVING count(*) > 1)",
        "sites(siteID)":
            "SELECT count(*) FROM (SELECT 1 FROM site GROUP BY sid HAVING count(*) > 1)",
        "customers(customerID)":
            "SELECT count(*) FROM (SELECT 1 FROM provider GROUP BY pid HAVING count(*) > 1)",
        "corporation_types(corporationType)":
            "SELECT count(*) FROM (SELECT 1 FROM region GROUP BY r_name HAVING count(*) > 1)",
        "customers by brand(corpType)":
            "SELECT count(*) FROM (SELECT 1 FROM provider GROUP BY brand HAVING count(*) > 1)",
    }),
    "dq_store_collision": """
SELECT store AS "storeNumber", count(DISTINCT site) AS sites
FROM (SELECT s_suppkey AS store, s_suppkey AS site FROM supplier
      UNION ALL SELECT CAST(n_nationkey AS BIGINT), -CAST(n_nationkey AS BIGINT) - 1 FROM nation)
GROUP BY 1 HAVING count(DISTINCT site) > 1""",
    "dq_line_arithmetic": _checks("line_arithmetic", DETAIL, {
        "invoice_detail": "SELECT count(*) FROM detail WHERE abs(amount - round(price * qty, 2)) > 0.005",
    }),
    "dq_orphans": _checks("orphans", f"{HEADER}, {ACCOUNT}, {DETAIL}, {FLEET}", {
        "invoice_header.account_id":
            "SELECT count(*) FROM header WHERE account_id NOT IN (SELECT account_id FROM account)",
        "invoice_detail.invoice_id":
            "SELECT count(*) FROM detail WHERE invoice_id NOT IN (SELECT invoice_id FROM header)",
        "invoices.fleetID":
            "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT fid FROM fleet)",
    }),
    "dq_key_audit": f"""WITH {HEADER}, {ACCOUNT}, {DETAIL}, {FLEET}
SELECT 'duplicate_keys' AS check_name, 'invoice_header(invoice_id)' AS subject, count(*) AS violations
FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'dimension_fanout', 'accounts(account_id)', count(*)
FROM (SELECT 1 FROM account GROUP BY account_id HAVING count(*) > 1)
UNION ALL SELECT 'dimension_fanout', 'fleets(fleetID)', count(*)
FROM (SELECT 1 FROM fleet GROUP BY fid HAVING count(*) > 1)
UNION ALL SELECT 'orphans', 'invoice_header.account_id', count(*)
FROM header WHERE account_id NOT IN (SELECT account_id FROM account)
UNION ALL SELECT 'orphans', 'invoice_detail.invoice_id', count(*)
FROM detail WHERE invoice_id NOT IN (SELECT invoice_id FROM header)
UNION ALL SELECT 'orphans', 'invoices.fleetID', count(*)
FROM orders WHERE o_custkey NOT IN (SELECT fid FROM fleet)""",
    "dq_bad_join_keys": _checks("bad_join_keys", f"{FACT}, {FLEET}, {SITE}, {KPI}", {
        "booked.fleetAccountNumber":
            "SELECT count(*) FROM fact LEFT JOIN fleet ON fid = o_custkey WHERE coalesce(fid, 0) = 0",
        "booked.storeNumber":
            "SELECT count(*) FROM fact LEFT JOIN site ON sid = l_suppkey WHERE coalesce(store, 0) = 0",
        "reported.fleetAccountNumber": "SELECT count(*) FROM kpi WHERE coalesce(fid, 0) = 0",
        "reported.storeNumber": "SELECT count(*) FROM kpi WHERE coalesce(store, 0) = 0",
    }),
    "doc_catalog_summary": f"""WITH {DOCUMENT}
SELECT file_name, CASE WHEN ok THEN kind ELSE '?' END AS kind, CASE WHEN ok THEN text END AS name,
       CASE WHEN ok THEN deleted END AS deleted, CASE WHEN ok THEN place END AS location,
       CASE WHEN ok THEN '[' || kind || '] ' || text
              || CASE WHEN deleted THEN ' [DELETED]' ELSE '' END
              || CASE WHEN place = '' THEN '' ELSE ' ' || place END
            ELSE '[?] ' || file_name || ' (could not parse)' END AS line
FROM doc""",
    "doc_catalog_hand_edited": """
WITH d AS (SELECT doc_id || '.metadata' AS file_name, doc_id % 12 IN (0, 1, 5, 6, 7, 8, 11) AS ok,
    doc_id % 12 IN (5, 6, 11) AS gone, coalesce(nullif(text, ''), '(unknown)') AS name,
    coalesce(' (in: ' || left(source, 8) || '...)', '') AS place FROM documents)
SELECT file_name, CASE WHEN ok THEN 'DOC' ELSE '?' END AS kind, CASE WHEN ok THEN gone END AS deleted,
       CASE WHEN ok THEN '[DOC] ' || name || CASE WHEN gone THEN ' [DELETED]' ELSE '' END || place
            ELSE '[?] ' || file_name || ' (could not parse)' END AS line
FROM d""",
    "doc_name_search": f"""WITH {DOCUMENT}
SELECT text AS name, file_name FROM doc WHERE ok AND contains(lower(text), 'license')""",
    "doc_ext_counts": """
WITH n AS (SELECT count(*) FILTER (lang = 'en') AS m, count(*) FILTER (lang = 'fr') AS c,
                  count(*) FILTER (lang = 'de') AS p FROM documents)
SELECT '.metadata' AS extension, m AS files FROM n UNION ALL SELECT '.content', c FROM n
UNION ALL SELECT '.pagedata', p FROM n UNION ALL SELECT 'total', m + c + p FROM n""",
}
