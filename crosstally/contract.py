"""Values a caller can rely on: status strings, code lists, headers, column names.

Everything here is data.  The modules that use it take it as a default argument, so another
client or partner swaps the value and keeps the code.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# --- fixed values: brand scope and fleet-code shapes -------------------------------------------
BRAND_CODES = ("T5C", "MBL")
FLEET_CODE_PREFIXES = ("MBL", "T5C", "AIN", "AIC")
STORE_PREFIX_LENGTH = 3
STORE_SUFFIX = "828"

# --- fixed values: reconciliation --------------------------------------------------------------
TOLERANCE = Decimal("1.00")
UNKNOWN_NAME = "<unknown>"
TOP_VARIANCES = 50
PREVIEW_ROWS = 50
DISPLAY_ROWS = 1000
MATCHED = "matched"
VARIANCE = "variance"
BOOKED_PREFIX = "mfc"
REPORTED_PREFIX = "driven"


@dataclass(frozen=True)
class Sides:
    """Names of the two parties; output columns and ``missing_*`` statuses are built from them."""

    booked: str = BOOKED_PREFIX
    reported: str = REPORTED_PREFIX

    @property
    def missing_booked(self) -> str:
        return f"missing_{self.booked}"

    @property
    def missing_reported(self) -> str:
        return f"missing_{self.reported}"

    def statuses(self) -> tuple[str, str, str, str]:
        return (MATCHED, VARIANCE, self.missing_booked, self.missing_reported)

    @property
    def net_balance(self) -> str:
        return f"{self.booked}Balance"

    @property
    def fee(self) -> str:
        return f"total{self.booked.capitalize()}Fee"

    @property
    def invoice_count(self) -> str:
        return f"{self.booked}InvoiceCount"

    @property
    def total_invoice(self) -> str:
        return f"{self.booked}TotalInvoice"

    @property
    def balance(self) -> str:
        return f"{self.booked}TotalBalance"

    @property
    def discount(self) -> str:
        return f"{self.booked}TotalDiscount"

    @property
    def gross(self) -> str:
        return f"{self.reported}GrossSales"

    @property
    def reported_discounts(self) -> str:
        return f"{self.reported}Discounts"

    @property
    def cars_per_day(self) -> str:
        return f"{self.reported}CarsPerDay"

    @property
    def oil_changes(self) -> str:
        return f"{self.reported}OilChanges"


SIDES = Sides()

# --- fixed values: service buckets, first match wins -------------------------------------------
SERVICE_RULES = (
    ("Oil change", ("oil change",)),
    ("Tire service", ("tire", "rotation")),
    ("Engine filters", ("engine filter", "oil filter")),
    ("Cabin air filters", ("cabin",)),
    ("Wipers", ("wiper",)),
    ("Brake service", ("brake",)),
    ("Battery", ("battery",)),
    ("Labor", ("labor",)),
)
SERVICE_DEFAULT = "Other"

# --- fixed values: partner KPI sheet, raw header -> column -------------------------------------
KPI_HEADERS = {
    "Year/Month": "yearMonth",
    "Date": "date",
    "Fleet Account Name": "fleetAccountName",
    "Fleet Account #": "fleetAccountNumber",
    "Region": "region",
    "Store #": "storeNumber",
    "Week Ending": "weekEnding",
    "COSC/FZ": "coscFz",
    "Air Filters - CY": "airFilters",
    "Cabin Filters - CY": "cabinFilters",
    "Cars Per Day - CY": "carsPerDay",
    "Coolant - CY": "coolant",
    "Discounts $ - CY": "discountsDollars",
    "Gross Sales - CY": "grossSales",
    "Oil Changes - CY": "oilChanges",
    "Wipers - CY": "wipers",
    "Differential Fluid % - CY": "differentialFluidPct",
}
KPI_DATE_COLUMNS = ("date", "weekEnding")
SERIAL_EPOCH = "1899-12-30"

# --- fixed values: sales files and documents ---------------------------------------------------
FILE_ROLES = (
    ("invoice_header", ("header",)),
    ("invoice_detail", ("detail",)),
    ("accounts", ("account", "customer", "client", "party")),
)
SALES_TAX_RATE = Decimal("0.0825")
CANCELLED_STATUS = "Cancelled"
FOLDER_TYPE = "CollectionType"
TRASH_PARENT = "trash"
UNKNOWN_DOCUMENT = "(unknown)"
DOCUMENT_EXTENSIONS = (".metadata", ".content", ".pagedata")
JDBC_FETCH_SIZE = 5000

# --- fixed values: columns of the source database, source name -> our name ---------------------
SOURCE_COLUMNS = {
    "corporation_types": {
        "CorporationTypeID": "corporationTypeID",
        "CorporationName": "corporationName",
        "CorporationType": "corporationType",
        "CorporationPrefix": "corporationPrefix",
        "StoreNumberLength": "storeNumberLength",
        "storeNumberPaddingCharacter": "storeNumberPaddingCharacter",
        "InvoicePercentFee": "invoicePercentFee",
        "InvoiceFlatFee": "invoiceFlatFee",
        "AIFee": "aiFee",
        "AIFeePct": "aiFeePct",
        "AIMinimumFee": "aiMinimumFee",
        "AICutFlatFee": "aiCutFlatFee",
        "AICutPercentFee": "aiCutPercentFee",
    },
    "customers": {
        "CustomerID": "customerID",
        "Customer_CompanyName": "customerCompanyName",
        "CorpType": "corpType",
        "Customer_CreatedOn": "customerCreatedOn",
        "Customer_InvoiceFee": "customerInvoiceFee",
        "invoicePctFee": "invoicePctFee",
        "invoiceMinimumFee": "invoiceMinimumFee",
        "invoiceFlatFee": "invoiceFlatFee",
        "aiFee": "aiFee",
        "aiInvoicePctFee": "aiInvoicePctFee",
        "aiInvoiceFlatFee": "aiInvoiceFlatFee",
        "aiInvoiceMinimumFee": "aiInvoiceMinimumFee",
        "aiCutPctFee": "aiCutPctFee",
        "aiCutFlatFee": "aiCutFlatFee",
        "factoredPct": "factoredPct",
        "factoredMultiplier": "factoredMultiplier",
        "factoredDiscounts": "factoredDiscounts",
        "factoredTypeId": "factoredTypeId",
    },
    "sites": {
        "SiteID": "siteID",
        "Store_Number": "storeNumber",
        "Site_Name": "siteName",
        "Site_Street_Address": "siteStreetAddress",
        "Site_City_Name": "siteCityName",
        "Site_State_Code": "siteStateCode",
        "Site_Zip_Code": "siteZipCode",
        "Site_Phone_Number": "sitePhoneNumber",
        "district": "district",
        "division": "division",
        "region": "region",
        "type": "type",
    },
    "fleets": {
        "FleetID": "fleetID",
        "Fleet_Code": "fleetCode",
        "Fleet_CompanyName": "fleetAccountName",
        "Fleet_Credit": "fleetCredit",
        "Fleet_Credit_PreLive": "fleetCreditPreLive",
        "Fleet_CreatedOn": "fleetCreatedOn",
        "Fleet_StartDate": "fleetStartDate",
        "Fleet_StopDate": "fleetStopDate",
        "Fleet_AccountClosed": "fleetAccountClosed",
        "Fleet_NationalAccount": "fleetNationalAccount",
        "UniqueAccountIdentifier": "uniqueAccountIdentifier",
    },
    "invoices": {
        "InvoiceID": "invoiceID",
        "Invoice_Number": "invoiceNumber",
        "CustomerID": "customerID",
        "FleetID": "fleetID",
        "SiteID": "siteID",
        "Invoice_Date": "invoiceDate",
        "Invoice_Total_Amount": "invoiceTotalAmount",
        "Invoice_Tax_Total_Amount": "invoiceTaxTotalAmount",
        "Prepaid_Total_Amount": "prepaidTotalAmount",
        "Invoice_TotalDiscounts": "invoiceTotalDiscounts",
        "Invoice_CCFees": "invoiceCCFees",
        "Invoice_InvoiceFee": "invoiceInvoiceFee",
        "Invoice_Import_Store_Number": "invoiceImportStoreNumber",
        "Invoice_BilledOutOn_AutoIntegrate": "invoiceBilledOutOnAutoIntegrate",
        "Invoice_BillingFees_AutoIntegrate": "invoiceBillingFeesAutoIntegrate",
        "voided": "voided",
    },
    "invoice_item_bridge": {
        "InvoiceItemBridgeID": "invoiceItemBridgeID",
        "InvoiceID": "invoiceID",
        "Service_Catg_Code": "serviceCatgCode",
        "Item_Description": "itemDescription",
        "Item_Detail": "itemDetail",
        "Item_Price": "itemPrice",
        "Service_Actual_Quantity": "serviceActualQuantity",
        "Service_Amount": "serviceAmount",
        "Service_Actual_Amount": "serviceActualAmount",
        "Sales_Unit_Code": "salesUnitCode",
        "Service_Validation_Code": "serviceValidationCode",
        "Service_Location": "serviceLocation",
        "LaborUnits": "laborUnits",
        "Operation": "operation",
        "Type": "type",
        "Item_CreatedOn": "itemCreatedOn",
    },
}
SOURCE_TABLES = {
    "corporation_types": "CorporationTypes",
    "customers": "Customer",
    "sites": "Site",
    "fleets": "Fleet",
    "invoices": "Invoice",
    "invoice_item_bridge": "InvoiceItemBridge",
}
