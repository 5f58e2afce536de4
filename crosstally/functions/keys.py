"""Keys that both parties can agree on, parsed from internal codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import FLEET_CODE_PREFIXES, STORE_PREFIX_LENGTH, STORE_SUFFIX
from .casts import int_from_text


def store_number(
    code: Column,
    prefix_length: int = STORE_PREFIX_LENGTH,
    suffix: str = STORE_SUFFIX,
    to: str = "int",
) -> Column:
    """Integer store number inside a raw store code.

    The brand prefix is always dropped, the suffix only when something is left between the two.
    The choice is made by shape alone: if the chosen piece is no number the result is NULL.
    """
    n = F.length(code)
    both = prefix_length + len(suffix)
    digits = F.when(
        code.endswith(suffix) & (n > both), F.substr(code, F.lit(prefix_length + 1), n - both)
    ).when(n > prefix_length, F.substr(code, F.lit(prefix_length + 1), n - prefix_length))
    return int_from_text(digits, to)


def account_number(code: Column, prefixes: Sequence[str] = FLEET_CODE_PREFIXES) -> Column:
    """Numeric part of ``PREFIX-number``; NULL for any other shape."""
    pattern = "^(?:" + "|".join(prefixes) + r")-(\d+)$"
    return F.regexp_extract(code, pattern, 1).try_cast("bigint")


def is_ai_invoice(billed_out_on: Column, billing_fee: Column) -> Column:
    """Billed through the automated channel: a bill date, or a positive fee."""
    return billed_out_on.isNotNull() | F.coalesce(billing_fee > 0, F.lit(False))
