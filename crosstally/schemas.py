"""One explicit schema per table; nothing is inferred from data.

Identifiers are BIGINT so that keys past 2^31 survive; money is DECIMAL(18,2) so that sums do
not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "corporation_types": """
        corporationTypeID INT, corporationName STRING, corporationType STRING,
        corporationPrefix STRING, storeNumberLength INT, storeNumberPaddingCharacter STRING,
        invoicePercentFee DECIMAL(9,6), invoiceFlatFee DECIMAL(18,2), aiFee DECIMAL(18,2),
        aiFeePct DECIMAL(9,6), aiMinimumFee DECIMAL(18,2), aiCutFlatFee DECIMAL(18,2),
        aiCutPercentFee DECIMAL(9,6)""",
    "customers": """
        customerID BIGINT, customerCompanyName STRING, corpType STRING,
        customerCreatedOn TIMESTAMP, customerInvoiceFee DECIMAL(18,2),
        invoicePctFee DECIMAL(9,6), invoiceMinimumFee DECIMAL(18,2),
        invoiceFlatFee DECIMAL(18,2), aiFee DECIMAL(18,2), aiInvoicePctFee DECIMAL(9,6),
        aiInvoiceFlatFee DECIMAL(18,2), aiInvoiceMinimumFee DECIMAL(18,2),
        aiCutPctFee DECIMAL(9,6), aiCutFlatFee DECIMAL(18,2), factoredPct DECIMAL(9,6),
        factoredMultiplier DECIMAL(9,6), factoredDiscounts DECIMAL(18,2), factoredTypeId INT""",
    "sites": """
        siteID BIGINT, storeNumber STRING, siteName STRING, siteStreetAddress STRING,
        siteCityName STRING, siteStateCode STRING, siteZipCode STRING, sitePhoneNumber STRING,
        district STRING, division STRING, region STRING, type STRING""",
    "fleets": """
        fleetID BIGINT, fleetCode STRING, fleetAccountNumber BIGINT, fleetAccountName STRING,
        fleetCredit DECIMAL(18,2), fleetCreditPreLive DECIMAL(18,2), fleetCreatedOn TIMESTAMP,
        fleetStartDate TIMESTAMP, fleetStopDate TIMESTAMP, fleetAccountClosed INT,
        fleetNationalAccount INT, uniqueAccountIdentifier STRING""",
    "invoices": """
        invoiceID BIGINT, invoiceNumber STRING, customerID BIGINT, fleetID BIGINT,
        siteID BIGINT, invoiceDate TIMESTAMP, invoiceTotalAmount DECIMAL(18,2),
        invoiceTaxTotalAmount DECIMAL(18,2), prepaidTotalAmount DECIMAL(18,2),
        invoiceTotalDiscounts DECIMAL(18,2), invoiceCCFees DECIMAL(18,2),
        invoiceInvoiceFee DECIMAL(18,2), invoiceImportStoreNumber STRING,
        invoiceBilledOutOnAutoIntegrate TIMESTAMP,
        invoiceBillingFeesAutoIntegrate DECIMAL(18,2), voided INT""",
    "invoice_item_bridge": """
        invoiceItemBridgeID BIGINT, invoiceID BIGINT, serviceCatgCode STRING,
        itemDescription STRING, itemDetail STRING, itemPrice DECIMAL(18,2),
        serviceActualQuantity DECIMAL(18,4), serviceAmount DECIMAL(18,2),
        serviceActualAmount DECIMAL(18,2), salesUnitCode STRING, serviceValidationCode STRING,
        serviceLocation STRING, laborUnits DECIMAL(18,4), operation STRING, type STRING,
        itemCreatedOn TIMESTAMP""",
    "partner_kpi": """
        yearMonth STRING, date DATE, fleetAccountName STRING, fleetAccountNumber BIGINT,
        region STRING, storeNumber BIGINT, weekEnding DATE, coscFz STRING, airFilters INT,
        cabinFilters INT, carsPerDay INT, coolant INT, discountsDollars DECIMAL(24,6),
        grossSales DECIMAL(24,6), oilChanges INT, wipers INT,
        differentialFluidPct DOUBLE""",
    "invoice_header": """
        invoice_id STRING, account_id STRING, invoice_date DATE, subtotal DECIMAL(18,2),
        discount_amount DECIMAL(18,2), tax_amount DECIMAL(18,2), total_amount DECIMAL(18,2)""",
    "invoice_detail": """
        invoice_id STRING, line_id STRING, description STRING, category STRING,
        quantity DECIMAL(18,4), unit_price DECIMAL(18,2), line_amount DECIMAL(18,2)""",
    "accounts": """
        account_id STRING, account_name STRING, parent_account_name STRING, segment STRING,
        status STRING, signup_date DATE, cancelled_date DATE, cancellation_reason STRING""",
    "document_metadata": """
        createdTime STRING, lastModified STRING, lastOpened STRING, lastOpenedPage INT,
        new BOOLEAN, parent STRING, pinned BOOLEAN, source STRING, type STRING,
        visibleName STRING, deleted BOOLEAN""",
}

#: Columns that may not be NULL, per table (the input contract of the sales files).
REQUIRED = {
    "invoice_header": (
        "invoice_id", "account_id", "invoice_date", "subtotal", "discount_amount",
        "tax_amount", "total_amount",
    ),
    "invoice_detail": ("invoice_id", "line_amount"),
    "accounts": ("account_id", "account_name"),
    "partner_kpi": (
        "weekEnding", "fleetAccountName", "fleetAccountNumber", "storeNumber", "grossSales",
        "discountsDollars", "carsPerDay", "oilChanges",
    ),
}

RECONCILIATION_TABLES = (
    "corporation_types", "customers", "sites", "fleets", "invoices", "invoice_item_bridge",
    "partner_kpi",
)
SALES_TABLES = ("invoice_header", "invoice_detail", "accounts")


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])
