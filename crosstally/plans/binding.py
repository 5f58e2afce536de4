"""Star-schema test tables presented in the schemas of the pipelines.

The driver's tables know nothing of invoices or KPI sheets.  Each function below selects and
renames columns of whole tables so that the unchanged operators run on them.  Amounts that the
tables lack (prepayments, fees, discounts in money) are derived from columns of the same row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import KPI_HEADERS, SERIAL_EPOCH
from ..functions.dates import week_ending
from ..operators.enrich import Charges
from ..schemas import schema

AS_OF = date(2001, 8, 1)  # last order date of the test tables
KEY_TYPE = "bigint"
SCOPE_CODES = ("ASIA", "EUROPE")
#: Customers per supplier in the test tables, at every size.
CUSTOMERS_PER_SITE = 15
PROVIDERS = 25

#: Words of the part names, first match wins.
PART_RULES = (
    ("Fasteners", ("bolt",)),
    ("Rings and rods", ("ring", "rod")),
    ("Drivetrain", ("gear",)),
    ("Flat stock", ("plate",)),
    ("Gadgets", ("widget", "gizmo")),
)
TIERS = (("XL", 4_000_000), ("Large", 2_500_000), ("Medium", 1_000_000), ("Small", 0))

#: All three states of the flag: set, clear, unknown.
_VOIDED = "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS voided"


def _money(sql: str) -> str:
    return f"CAST({sql} AS DECIMAL(18,2))"


#: Further amounts of a line item with its ``total``, and what an invoice charges by them.
_DISCOUNT_AND_TAX = {
    "discount": _money("total * CAST(l_discount AS DECIMAL(4,2))"),
    "tax": _money("total * CAST(l_tax AS DECIMAL(4,2))"),
}
_CHARGED = {
    "invoiceTotalAmount": "total",
    "invoiceTaxTotalAmount": "tax",
    "prepaidTotalAmount": "CASE WHEN l_returnflag = 'R' THEN discount END",
    "invoiceTotalDiscounts": "discount",
    "invoiceCCFees": "CASE WHEN l_returnflag = 'A' THEN tax END",
    "invoiceInvoiceFee": f"CASE WHEN l_returnflag <> 'N' THEN {_money('l_linenumber')} END",
}
#: Three small columns of a line item as one number and back, for any INT and DECIMAL(4,2) and NULL.
#: A shuffled row is compressed by its gaps: beside a key each small column takes as much as a price.
_SMALL = """
    shiftleft(coalesce(l_linenumber + 2147483648L, 4294967296L), 30)
    + shiftleft(coalesce(CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT) + 9999, 32767L), 15)
    + coalesce(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS BIGINT) + 9999, 32767L)"""
_RATE = "CAST((nullif({}, 32767) - 9999) * 0.01BD AS DECIMAL(4,2))"
_FROM_SMALL = {
    "l_linenumber": "CAST(nullif(shiftright(small, 30), 4294967296) - 2147483648 AS INT)",
    "l_discount": _RATE.format("shiftright(small, 15) & 32767"),
    "l_tax": _RATE.format("small & 32767"),
}
_PROVIDER = f"l_suppkey % {PROVIDERS}"


class Star:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The whole table; its footer is asked for the schema once per query."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._read[name]

    def _joined(self, left: DataFrame, right: str, left_key: str, right_key: str) -> DataFrame:
        return left.join(self.table(right), F.col(left_key) == F.col(right_key))

    def _nations(self) -> Column:
        """Nations with their region by key, as a scalar subquery: 25 entries at every size.

        A lookup instead of a join leaves a dimension the size of its own table, by which Spark
        decides on broadcasts; joins would count as the product of their inputs.
        """
        located = self._joined(self.table("nation"), "region", "n_regionkey", "r_regionkey")
        place = F.struct("n_name", "r_name", "n_regionkey")
        return located.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", place)))).scalar()

    # -- reconciliation ------------------------------------------------------------------------

    def _facts(self) -> DataFrame:
        """Line items with their order; amounts become money once, before anything uses them."""
        priced = self.table("lineitem").selectExpr("*", f"{_money('l_extendedprice')} AS total")
        money = priced.selectExpr("*", *(f"{sql} AS {name}" for name, sql in _DISCOUNT_AND_TAX.items()))
        return self._joined(money, "orders", "l_orderkey", "o_orderkey")

    def invoices(self) -> DataFrame:
        """Invoice fact at line grain, several rows per invoice id."""
        return self._facts().selectExpr(
            "l_orderkey AS invoiceID",
            "concat('INV-', l_orderkey) AS invoiceNumber",
            f"{_PROVIDER} AS customerID",
            "o_custkey AS fleetID",
            "l_suppkey AS siteID",
            "o_orderdate AS invoiceDate",
            *(f"{sql} AS {name}" for name, sql in _CHARGED.items()),
            "CASE WHEN l_returnflag = 'N' THEN l_shipdate END AS invoiceBilledOutOnAutoIntegrate",
            "CASE WHEN l_returnflag = 'R' THEN discount END AS invoiceBillingFeesAutoIntegrate",
            _VOIDED,
        )

    def invoice_headers(self) -> DataFrame:
        """What the line items of ``invoices`` share with their order."""
        return self.table("orders").selectExpr(
            "o_orderkey AS invoiceID",
            "concat('INV-', o_orderkey) AS invoiceNumber",
            "o_custkey AS fleetID",
            "o_orderdate AS invoiceDate",
            _VOIDED,
        )

    def invoice_charges(self) -> Charges:
        """What they have of their own; with the headers the same rows as ``invoices``."""
        rows = self.table("lineitem").selectExpr(
            "l_orderkey AS invoiceID",
            "l_suppkey",
            f"{_money('l_extendedprice')} AS total",
            f"{_SMALL} AS small",
            "l_returnflag",
        )
        computed = _FROM_SMALL, _DISCOUNT_AND_TAX, _CHARGED | {"customerID": _PROVIDER}
        return Charges(rows, "l_suppkey", computed)

    def order_invoices(self) -> DataFrame:
        """Invoice headers, one row per order: the parent of the line items."""
        return self.table("orders").selectExpr(
            "o_orderkey AS invoiceID",
            "concat('INV-', o_orderkey) AS invoiceNumber",
            f"o_orderkey % {PROVIDERS} AS customerID",
            "o_custkey AS fleetID",
            f"o_custkey div {CUSTOMERS_PER_SITE} AS siteID",
            "o_orderdate AS invoiceDate",
            f"{_money('o_totalprice')} AS invoiceTotalAmount",
            f"{_money('NULL')} AS prepaidTotalAmount",
            f"{_money('NULL')} AS invoiceInvoiceFee",
            _VOIDED,
        )

    def fleets(self) -> DataFrame:
        """Every account; those in debt under another id, so that the left join has misses."""
        return self.table("customer").selectExpr(
            "CASE WHEN c_acctbal >= 0 THEN c_custkey ELSE -c_custkey - 1 END AS fleetID",
            "concat('MBL-', c_custkey) AS fleetCode",
            "c_custkey AS fleetAccountNumber",
            "c_name AS fleetAccountName",
        )

    def sites(self) -> DataFrame:
        """Store codes with a brand prefix by region and, for some, the suffix."""
        located = self.table("supplier").withColumn("place", self._nations()[F.col("s_nationkey")])
        return located.select("s_suppkey", "s_name", "place.*").selectExpr(
            "s_suppkey AS siteID",
            """concat(CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'T5C'
                           WHEN r_name = 'ASIA' THEN 'MBL' ELSE 'AIN' END,
                      s_suppkey,
                      CASE WHEN s_suppkey % 4 = 0 THEN '828' ELSE '' END) AS storeNumber""",
            "s_name AS siteName",
            "r_name AS region",
            "n_name AS district",
            "concat('Division ', n_regionkey) AS division",
        )

    def second_brand_sites(self) -> DataFrame:
        """Sites of another brand whose padded numbers repeat those of the suppliers."""
        return self.table("nation").selectExpr(
            "-CAST(n_nationkey AS BIGINT) - 1 AS siteID",
            "concat('MBL00', n_nationkey) AS storeNumber",
        )

    def customers(self) -> DataFrame:
        regions = F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name")))
        names = self.table("region").agg(regions).scalar()
        located = self.table("nation").withColumn("r_name", names[F.col("n_regionkey")])
        return located.selectExpr(
            "CAST(n_nationkey AS BIGINT) AS customerID",
            "n_name AS customerCompanyName",
            "r_name AS corpType",
            f"CASE WHEN n_nationkey % 2 = 0 THEN {_money('1.50')} END AS aiInvoiceFlatFee",
            """CASE WHEN n_nationkey % 3 = 0 THEN CAST(0.01 AS DECIMAL(9,6)) END
               AS aiInvoicePctFee""",
        )

    def corporation_types(self) -> DataFrame:
        return self.table("region").selectExpr(
            "r_name AS corporationType",
            "CASE WHEN r_name <> 'ASIA' THEN CAST(0.02 AS DECIMAL(9,6)) END AS aiFeePct",
        )

    def partner_kpi(self) -> DataFrame:
        """The other party's rows: voided ones included, urgent orders a week late, one line off."""
        gross = """total - CASE WHEN l_returnflag = 'R' THEN discount ELSE 0 END
                         + CASE WHEN l_linenumber = 3 THEN 25 ELSE 0 END"""
        late = F.when(F.col("o_orderpriority") == "1-URGENT", 7).otherwise(0)
        return self._facts().select(
            F.date_add(week_ending(F.col("o_orderdate")), late).alias("weekEnding"),
            F.expr("concat('Account ', o_custkey) AS fleetAccountName"),
            F.expr("o_custkey AS fleetAccountNumber"),
            F.expr("l_suppkey AS storeNumber"),
            F.expr("1 AS carsPerDay"),
            F.expr("CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS oilChanges"),
            F.expr("discount AS discountsDollars"),
            F.expr(f"{_money(gross)} AS grossSales"),
        )

    def kpi_sheet(self) -> DataFrame:
        """A raw partner sheet per store and week: text cells, serial and ISO dates, blank rows."""
        weekly = (
            self._facts()
            .groupBy(F.col("l_suppkey").alias("store"), week_ending(F.col("o_orderdate")).alias("week"))
            .agg(F.sum("total").alias("gross"), F.count(F.lit(1)).alias("cars"))
        )
        cells = {
            "Year/Month": "date_format(week, 'yyyy/MM')",
            "Date": "concat(week, ' 00:00:00')",
            "Store #": "concat(' ', store)",
            "Week Ending": f"""CASE WHEN store % 2 = 1 THEN CAST(week AS STRING)
                ELSE concat(datediff(week, DATE '{SERIAL_EPOCH}'),
                            CASE WHEN cars > 2 THEN '.75' ELSE '' END) END""",
            "Cars Per Day - CY": "concat(cars, '.5')",
            "Gross Sales - CY": "CAST(gross AS STRING)",
        }
        nothing = "CAST(NULL AS STRING)"
        titles = {h: f" {h} " if h == "Date" else h for h in KPI_HEADERS}  # one has blanks around
        filled = weekly.selectExpr(*[f"{cells.get(h, nothing)} AS `{t}`" for h, t in titles.items()])
        blank = self.table("region").selectExpr(*[f"{nothing} AS `{t}`" for t in titles.values()])
        return filled.unionByName(blank)

    def lines(self) -> DataFrame:
        priced = self.table("lineitem").selectExpr("*", f"{_money('l_extendedprice')} AS amount")
        return self._joined(priced, "part", "l_partkey", "p_partkey").selectExpr(
            "l_orderkey * 10 + l_linenumber AS invoiceItemBridgeID",
            "l_orderkey AS invoiceID",
            "p_type AS serviceCatgCode",
            "p_name AS itemDescription",
            "CAST(l_quantity AS DECIMAL(18,4)) AS serviceActualQuantity",
            "amount AS serviceAmount",
            f"""{_money(f"amount - {_money('amount * CAST(l_discount AS DECIMAL(4,2))')}")}
                AS serviceActualAmount""",
        )

    # -- sales ---------------------------------------------------------------------------------

    def header(self) -> DataFrame:
        """Headers whose arithmetic holds except for open orders with a discount."""
        priced = self.table("orders").selectExpr("*", f"{_money('o_totalprice')} AS total")
        parts = priced.selectExpr(
            "*",
            f"{_money('total * CAST(0.08 AS DECIMAL(4,2))')} AS tax",
            f"""CASE WHEN o_orderpriority = '1-URGENT'
                     THEN {_money('total * CAST(0.02 AS DECIMAL(4,2))')}
                     ELSE {_money('0')} END AS discount""",
        )
        return parts.selectExpr(
            "o_orderkey AS invoice_id",
            "o_custkey AS account_id",
            "o_orderdate AS invoice_date",
            _money("total - tax + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE discount END")
            + " AS subtotal",
            "discount AS discount_amount",
            "tax AS tax_amount",
            "total AS total_amount",
        )

    def detail(self) -> DataFrame:
        return self._joined(self.table("lineitem"), "part", "l_partkey", "p_partkey").selectExpr(
            "l_orderkey AS invoice_id",
            "l_linenumber AS line_id",
            "p_name AS description",
            "CASE WHEN p_size > 25 THEN p_type END AS category",
            "CAST(l_quantity AS DECIMAL(18,4)) AS quantity",
            f"{_money('p_retailprice')} AS unit_price",
            f"{_money('l_extendedprice')} AS line_amount",
        )

    def detail_lines(self) -> DataFrame:
        """Keys and amounts of the details, without the join that describes them."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS invoice_id",
            "l_linenumber AS line_id",
            f"{_money('l_extendedprice')} AS line_amount",
        )

    def accounts(self) -> DataFrame:
        """Every third account has a parent; the balance says which are cancelled, and when."""
        cents = "CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents"
        located = self._joined(self.table("customer"), "nation", "c_nationkey", "n_nationkey")
        return located.selectExpr("*", cents).selectExpr(
            "c_custkey AS account_id",
            "c_name AS account_name",
            "CASE WHEN c_custkey % 3 = 0 THEN n_name END AS parent_account_name",
            "c_mktsegment AS segment",
            "CASE WHEN cents % 10 = 0 THEN 'Cancelled' ELSE 'Active' END AS status",
            f"""CASE WHEN cents % 10 = 0
                     THEN date_sub(DATE '{AS_OF}', CAST(cents div 10 % 24 * 30 AS INT)) END
                AS cancelled_date""",
            """CASE WHEN cents % 10 = 0
                    THEN elt(CAST(cents div 10 % 4 AS INT) + 1,
                             'price', 'closed', 'service', 'merged') END AS cancellation_reason""",
        )

    # -- documents -----------------------------------------------------------------------------

    def metadata_files(self) -> DataFrame:
        """Documents as metadata files; those in one language are plain text and do not parse."""
        labels = self.table("labels").select("doc_id", "toxic")
        return self.table("documents").join(labels, "doc_id", "left").selectExpr(
            "concat(doc_id, '.metadata') AS file_name",
            """CASE WHEN lang = 'es' THEN text ELSE to_json(struct(
                 CASE WHEN n_chars > 2000 THEN 'CollectionType' ELSE 'DocumentType' END AS type,
                 text AS visibleName,
                 CASE WHEN toxic = 1 THEN 'trash' WHEN lang = 'fr' THEN ''
                      ELSE concat(source, '-shelf-', lang) END AS parent,
                 toxic = 1 AS deleted)) END AS text""",
        )

    def odd_metadata_files(self) -> DataFrame:
        """The same as hand-edited files: blanks around, things behind, ``deleted`` of other types."""
        return self.table("documents").selectExpr(
            "doc_id", "to_json(struct(text AS visibleName, source AS parent)) AS text"
        ).selectExpr(
            "concat(doc_id, '.metadata') AS file_name",
            r"""CASE doc_id % 12
                 WHEN 0 THEN concat('\n', text)
                 WHEN 1 THEN concat('\t\r\n ', text, '\r\n')
                 WHEN 2 THEN concat(text, ' x')
                 WHEN 3 THEN concat(text, text)
                 WHEN 4 THEN concat("{'visibleName':'H", doc_id, "'}")
                 WHEN 5 THEN concat(left(text, length(text) - 1), ',"deleted":"0"}')
                 WHEN 6 THEN concat(left(text, length(text) - 1), ',"deleted":"false"}')
                 WHEN 7 THEN concat(left(text, length(text) - 1), ',"deleted":0.0}')
                 WHEN 8 THEN concat(left(text, length(text) - 1), ',"deleted":null}')
                 WHEN 9 THEN concat('[', text, ']')
                 WHEN 10 THEN concat(text, '}')
                 ELSE concat('{"deleted":false,', substring(text, 2, length(text) - 2), ',"deleted":[0]}') END AS text""",
        )

    def document_files(self) -> DataFrame:
        """File names only, with one extension per language."""
        return self.table("documents").selectExpr(
            """concat(doc_id, CASE lang WHEN 'en' THEN '.metadata' WHEN 'fr' THEN '.content'
                                        WHEN 'de' THEN '.pagedata' ELSE '.pdf' END) AS file_name"""
        )

    def empty_kpi(self) -> DataFrame:
        return self.spark.createDataFrame([], schema("partner_kpi"))
