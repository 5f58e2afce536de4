"""Account-level sales questions over invoice headers, details and accounts.

Facts are aggregated per account and period before they meet the accounts: an account that owns a
large share of the invoices then reaches the join as one row per period.  ``as_of`` is always an
argument, so a rerun gives the same answer.

Wherever a question takes invoice headers, it takes their ``daily_cube`` as well: invoices, billed
and net revenue per account and day.  Written once, the cube answers all of them but the service
breakdown, which needs the invoices themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CANCELLED_STATUS, SERVICE_RULES
from ..functions.dates import month_start, months_before
from ..functions.labels import Rules, service_of_line
from ..functions.sums import exact_sum
from .filters import between_days, keep

TRAILING_MONTHS = 12


def _days(header: DataFrame) -> DataFrame:
    """(account_id, day, billed, net, invoices) of invoice headers, or the cube as it is."""
    if "billed" in header.columns:
        return header
    return header.select(
        "account_id",
        F.col("invoice_date").cast("date").alias("day"),
        F.col("total_amount").alias("billed"),
        (F.col("subtotal") - F.col("discount_amount")).alias("net"),
        F.lit(1).cast("bigint").alias("invoices"),
    )


def daily_cube(header: DataFrame) -> DataFrame:
    """Invoices, billed and net revenue per account and day.

    A hot account is spread over its days, and money is summed as whole cents.
    """
    days = _days(header)
    return days.groupBy("account_id", "day").agg(*_sums(days, "billed", "net"))


def _sums(days: DataFrame, *revenues: str) -> list[Column]:
    return [*(exact_sum(days, r).alias(r) for r in revenues), F.sum("invoices").alias("invoices")]


def _totals(days: DataFrame, net: bool) -> tuple[Column, Column]:
    """Revenue and invoices of a group of days."""
    return exact_sum(days, "net" if net else "billed").alias("revenue"), F.sum("invoices").alias("invoices")


def _added(df: DataFrame, count: str = "invoices") -> tuple[Column, Column]:
    return exact_sum(df, "revenue").alias("revenue"), F.sum(count).alias(count)


def attribute(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Adds account name and parent organisation to rows that carry ``account_id``.

    Without accounts, or for an unknown account, the raw id stands in for both.
    """
    raw = F.col("account_id").cast("string")
    if accounts is None:
        return df.withColumns({"account_name": raw, "org": raw})
    known = accounts.select("account_id", "account_name", "parent_account_name")
    name = F.coalesce(F.col("account_name"), raw)
    return (
        df.join(known, "account_id", "left")
        .withColumns({"account_name": name, "org": F.coalesce(F.col("parent_account_name"), name)})
        .drop("parent_account_name")
    )


def _owned_by(df: DataFrame, accounts: DataFrame | None, org: str | None) -> DataFrame:
    """Rows that may belong to an organisation, by account id, before anything is aggregated.

    The ids are those of its accounts, and the name itself where it is an id.
    """
    if org is None:
        return df
    own_id = F.lit(org).try_cast(df.schema["account_id"].dataType).alias("account_id")
    ids = df.sparkSession.range(1).select(own_id).filter("account_id IS NOT NULL")
    if accounts is not None:
        name = F.coalesce(F.col("parent_account_name"), F.col("account_name"))
        ids = accounts.filter(name == org).select("account_id").union(ids)
    return df.join(ids, "account_id", "left_semi")


def _for_org(df: DataFrame, org: str | None) -> DataFrame:
    """One parent organisation, or one account by id; all of them when no name is given."""
    if org is None:
        return df
    return df.filter((F.col("org") == org) | (F.col("account_id").cast("string") == org))


def org_monthly(
    header: DataFrame,
    accounts: DataFrame | None = None,
    org: str | None = None,
    start: date | None = None,
    end: date | None = None,
    net: bool = False,
) -> DataFrame:
    """Q1: monthly billings per parent organisation."""
    dated = _owned_by(keep(_days(header), between_days(F.col("day"), start, end)), accounts, org)
    per_account = dated.groupBy("account_id", month_start(F.col("day")).alias("month")).agg(
        *_totals(dated, net)
    )
    owned = _for_org(attribute(per_account, accounts), org)
    return owned.groupBy("org", "month").agg(*_added(owned))


def org_services(
    header: DataFrame,
    detail: DataFrame,
    accounts: DataFrame | None = None,
    org: str | None = None,
    start: date | None = None,
    end: date | None = None,
    rules: Rules = SERVICE_RULES,
) -> DataFrame:
    """Q1: service breakdown per parent organisation."""
    dated = keep(header, between_days(F.col("invoice_date"), start, end))
    owners = _owned_by(dated, accounts, org).select("invoice_id", "account_id")
    lines = detail.select(
        "invoice_id",
        service_of_line(F.col("category"), F.col("description"), rules).alias("service_type"),
        "line_amount",
    )
    per_account = (
        lines.join(owners, "invoice_id")
        .groupBy("account_id", "service_type")
        .agg(exact_sum(lines, "line_amount").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    )
    owned = _for_org(attribute(per_account, accounts), org)
    return owned.groupBy("org", "service_type").agg(*_added(owned, "lines"))


def revenue_by_year(header: DataFrame, net: bool = False) -> DataFrame:
    """Q2: revenue and invoices per calendar year."""
    days = _days(header)
    return days.groupBy(F.year("day").alias("year")).agg(*_totals(days, net))


def revenue_by_month(header: DataFrame, net: bool = False) -> DataFrame:
    """Q2: revenue and invoices per month."""
    days = _days(header)
    return days.groupBy(month_start(F.col("day")).alias("month")).agg(*_totals(days, net))


def segment_revenue_by_year(
    header: DataFrame, accounts: DataFrame, segment: str | None = None, net: bool = False
) -> DataFrame:
    """Q2 split by account segment, or for one segment."""
    days = _days(header)
    per_account = days.groupBy("account_id", F.year("day").alias("year")).agg(*_totals(days, net))
    known = accounts.select("account_id", "segment")
    if segment is not None:
        known = known.filter(F.col("segment") == segment)
    how = "left" if segment is None else "inner"
    joined = per_account.join(known, "account_id", how)
    return joined.groupBy("segment", "year").agg(*_added(joined))


def yoy_growth(header: DataFrame, net: bool = False) -> DataFrame:
    """Q3: change against the calendar year before; NULL when that year is absent or not positive.

    The window is unpartitioned, but it runs over one row per year.
    """
    by_year = revenue_by_year(header, net).select("year", F.col("revenue").cast("double"))
    order = Window.orderBy("year")
    is_next = F.lag("year").over(order) == F.col("year") - 1
    previous = F.when(is_next, F.lag("revenue").over(order))
    return by_year.withColumn("previous_revenue", previous).withColumn(
        "growth_pct",
        F.when(
            F.col("previous_revenue") > 0,
            (F.col("revenue") - F.col("previous_revenue")) / F.col("previous_revenue"),
        ),
    )


def seasonality(header: DataFrame, net: bool = False) -> DataFrame:
    """Q3: mean revenue of a calendar month relative to the mean of all months.

    The window is unpartitioned, but it runs over twelve rows.
    """
    by_month = revenue_by_month(header, net)
    per_calendar_month = by_month.groupBy(F.month("month").alias("month_of_year")).agg(
        F.count(F.lit(1)).alias("months"), F.sum("revenue").alias("total")
    )
    everything = Window.partitionBy()
    overall = F.sum("total").over(everything).cast("double") / F.sum("months").over(everything)
    mean = F.col("total").cast("double") / F.col("months")
    return per_calendar_month.select(
        "month_of_year",
        "months",
        mean.alias("mean_revenue"),
        F.when(overall > 0, mean / overall).alias("seasonal_index"),
    )


def fleets_per_parent(accounts: DataFrame) -> DataFrame:
    """Q4: accounts under each parent organisation."""
    return (
        accounts.filter(F.col("parent_account_name").isNotNull())
        .groupBy("parent_account_name")
        .agg(F.count(F.lit(1)).alias("fleets"))
    )


def service_mix(detail: DataFrame, rules: Rules = SERVICE_RULES) -> DataFrame:
    """Q5: revenue, lines and share of the total per service type.

    The total is a scalar subquery over the same grouped rows.  It asks for both sums, so that its
    plan equals the one outside and the details are scanned and shuffled once for both.
    """
    service = service_of_line(F.col("category"), F.col("description"), rules)
    grouped = detail.groupBy(service.alias("service_type")).agg(
        exact_sum(detail, "line_amount").alias("revenue"), F.count(F.lit(1)).alias("lines")
    )
    total = grouped.agg(
        F.struct(F.sum("revenue").cast("double").alias("revenue"), F.sum("lines").alias("lines"))
    ).scalar()
    return grouped.withColumn(
        "share", F.try_divide(F.col("revenue").cast("double"), total["revenue"])
    )


def trailing_revenue(
    header: DataFrame, as_of: date, months: int = TRAILING_MONTHS, net: bool = False
) -> DataFrame:
    """Revenue per account over the ``months`` up to ``as_of``."""
    recent = keep(_days(header), between_days(F.col("day"), months_before(as_of, months), as_of))
    return recent.groupBy("account_id").agg(_totals(recent, net)[0])


def account_tiers(
    header: DataFrame,
    accounts: DataFrame,
    as_of: date,
    tiers: Sequence[tuple[str, int]],
    net: bool = False,
) -> DataFrame:
    """Q6: tier of every account; ``tiers`` is (name, lower bound), largest bound first."""
    spent = F.coalesce(F.col("revenue"), F.lit(0))
    (name, bound), *rest = tiers
    tier = F.when(spent >= bound, name)
    for name, bound in rest:
        tier = tier.when(spent >= bound, name)
    return accounts.select("account_id", "account_name").join(
        trailing_revenue(header, as_of, net=net), "account_id", "left"
    ).select("account_id", "account_name", spent.alias("revenue"), tier.alias("tier"))


def size_tiers(
    header: DataFrame,
    accounts: DataFrame,
    as_of: date,
    tiers: Sequence[tuple[str, int]],
    net: bool = False,
) -> DataFrame:
    """Q6: accounts and revenue per tier."""
    return account_tiers(header, accounts, as_of, tiers, net).groupBy("tier").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("revenue").alias("revenue")
    )


def inactive_accounts(
    header: DataFrame, accounts: DataFrame, as_of: date, months: int = TRAILING_MONTHS
) -> DataFrame:
    """Q7: accounts that are not cancelled and have no invoice in the ``months`` up to ``as_of``.

    Active ids are made distinct before the anti join: the map-side half collapses a hot account.
    """
    active = (
        keep(_days(header), between_days(F.col("day"), months_before(as_of, months), as_of))
        .select("account_id")
        .distinct()
    )
    live = accounts.filter(
        F.col("cancelled_date").isNull()
        & (F.coalesce(F.col("status"), F.lit("")) != CANCELLED_STATUS)
    )
    return live.join(active, "account_id", "left_anti").select("account_id", "account_name")


def cancellations(
    accounts: DataFrame, as_of: date, windows: Sequence[int] = (12, 24)
) -> DataFrame:
    """Q9: accounts cancelled in each trailing window, in one pass."""
    day = F.col("cancelled_date")
    counts = accounts.agg(
        *[
            F.count_if(
                (day >= F.lit(months_before(as_of, m))) & (day <= F.lit(as_of))
            ).alias(str(m))
            for m in windows
        ]
    )
    rows = [
        F.struct(F.lit(m).alias("window_months"), F.col(str(m)).alias("cancelled")) for m in windows
    ]
    return counts.select(F.inline(F.array(*rows)))


def lost_revenue(
    header: DataFrame, accounts: DataFrame, months: int = TRAILING_MONTHS, net: bool = False
) -> DataFrame:
    """Q10: revenue of each cancelled account in the ``months`` before its cancellation.

    Only invoices of cancelled accounts between the first window's begin and the last cancellation
    are read on.  They meet the windows before they are summed: the sum per account and
    cancellation combines map-side, and the join back then has one row each.
    """
    cancelled = accounts.filter(F.col("cancelled_date").isNotNull())
    begin, end = F.add_months("cancelled_date", -months), F.col("cancelled_date")
    span = cancelled.agg(F.struct(F.min(begin).alias("first"), F.max(end).alias("last"))).scalar()
    days = _days(header)
    day = F.col("day")
    windows = cancelled.select("account_id", end).distinct()
    inside = days.filter((day >= span["first"]) & (day < span["last"])).join(windows, "account_id")
    inside = inside.filter((day >= begin) & (day < end))
    sums = inside.groupBy("account_id", "cancelled_date").agg(_totals(inside, net)[0])
    return (
        cancelled.select("account_id", "account_name", "cancelled_date", "cancellation_reason")
        .distinct()
        .join(sums, ["account_id", "cancelled_date"], "left")
        .select(
            "account_id", "account_name", "cancelled_date", "cancellation_reason",
            F.coalesce("revenue", F.lit(0)).alias("lost_revenue"),
        )
    )


def cancellation_reasons(
    header: DataFrame, accounts: DataFrame, months: int = TRAILING_MONTHS, net: bool = False
) -> DataFrame:
    """Q11: cancelled accounts and lost revenue per reason."""
    return lost_revenue(header, accounts, months, net).groupBy("cancellation_reason").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("lost_revenue").alias("lost_revenue")
    )
