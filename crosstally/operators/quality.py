"""Checks of the input contract; each returns (check_name, subject, violations) rows.

Every check is one pass with map-side partial results; key checks count per key first, so a key
that holds a large share of the rows is a single partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import store_number
from ..functions.money import billed_total, line_total, or_zero

HALF_CENT = "0.005"


def _one(df: DataFrame, check: str, subject: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(check).alias("check_name"), F.lit(subject).alias("subject"), "violations"
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(df: DataFrame, check: str, tests: Mapping[str, Column]) -> DataFrame:
    """One pass over ``df``, one output row per test."""
    names = list(tests)
    counted = df.agg(*[F.count_if(tests[n]).alias(f"c{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(
            F.lit(check).alias("check_name"),
            F.lit(n).alias("subject"),
            F.col(f"c{i}").alias("violations"),
        )
        for i, n in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows)))


def required_nulls(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """DQ1: NULLs per required column."""
    return union_all(
        [
            _counts(df, "required_nulls", {f"{t}.{c}": F.col(c).isNull() for c in columns})
            for t, (df, columns) in tables.items()
        ]
    )


def duplicate_keys(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], check: str = "duplicate_keys"
) -> DataFrame:
    """DQ2/DQ5: keys that occur more than once."""
    return union_all(
        [
            _one(
                df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1),
                check, f"{t}({', '.join(keys)})", F.count(F.lit(1)),
            )
            for t, (df, keys) in tables.items()
        ]
    )


def dimension_fanout(dimensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """DQ5: dimension keys that would multiply fact rows."""
    return duplicate_keys({t: (df, [k]) for t, (df, k) in dimensions.items()}, "dimension_fanout")


def total_arithmetic(header: DataFrame) -> DataFrame:
    """DQ3: billed total against subtotal, discount and tax."""
    expected = billed_total(F.col("subtotal"), F.col("discount_amount"), F.col("tax_amount"))
    off = F.abs(F.col("total_amount") - expected) > F.lit(HALF_CENT).cast("decimal(4,3)")
    return _counts(header, "total_arithmetic", {"invoice_header": off})


def subtotal_vs_lines(header: DataFrame, detail: DataFrame) -> DataFrame:
    """DQ4: subtotal against the sum of the lines; an invoice without lines sums to zero."""
    sums = detail.groupBy("invoice_id").agg(F.sum("line_amount").alias("line_sum"))
    joined = header.select("invoice_id", "subtotal").join(sums, "invoice_id", "left")
    off = F.abs(F.col("subtotal") - or_zero(F.col("line_sum"))) > F.lit(HALF_CENT).cast(
        "decimal(4,3)"
    )
    return _counts(
        joined,
        "subtotal_vs_lines",
        {"invoice_header.subtotal": off, "invoice_header without lines": F.col("line_sum").isNull()},
    )


def line_arithmetic(detail: DataFrame) -> DataFrame:
    """DQ7: line amount against price times quantity."""
    off = F.abs(F.col("line_amount") - line_total(F.col("unit_price"), F.col("quantity"))) > F.lit(
        HALF_CENT
    ).cast("decimal(4,3)")
    return _counts(detail, "line_arithmetic", {"invoice_detail": off})


def orphans(
    links: Mapping[str, tuple[DataFrame, str, DataFrame, str]],
) -> DataFrame:
    """DQ8: rows whose foreign key is set but resolves to nothing.

    Children are counted per key before the anti join, which then sees each key once.
    """
    return union_all(
        [
            _one(
                child.filter(F.col(fk).isNotNull())
                .groupBy(F.col(fk).alias("_fk"))
                .agg(F.count(F.lit(1)).alias("n"))
                .join(parent.select(F.col(pk).alias("_fk")), "_fk", "left_anti"),
                "orphans", name, F.sum("n"),
            )
            for name, (child, fk, parent, pk) in links.items()
        ]
    )


def key_audit(
    keys: Mapping[str, tuple[DataFrame, str, str, Mapping[str, tuple[DataFrame, str]]]],
) -> DataFrame:
    """DQ2, DQ5 and DQ8 of keys and all that refers to them: one shuffle per key.

    ``keys`` gives, per table, its rows, its key, the name of the check for keys that occur more
    than once, and the references (name, rows, column).  Both sides' keys are united under a tag
    and counted per key and tag, map-side first, so a hot key is one partial row per task.  Rows
    are those of ``duplicate_keys``, ``dimension_fanout`` and ``orphans``.
    """
    found = []
    for table, (rows, key, check, children) in keys.items():
        tagged = [rows.select(F.col(key).alias("key"), F.lit(0).alias("tag"))]
        tagged += [
            child.select(F.col(fk).alias("key"), F.lit(i).alias("tag"))
            for i, (child, fk) in enumerate(children.values(), 1)
        ]
        counts = union_all(tagged).groupBy("key").agg(
            *[F.count_if(F.col("tag") == i).alias(f"n{i}") for i in range(len(tagged))]
        )
        lost = (F.col("n0") == 0) & F.col("key").isNotNull()
        totals = counts.agg(
            F.count_if(F.col("n0") > 1).alias("c0"),
            *[F.coalesce(F.sum(F.when(lost, F.col(f"n{i}"))), F.lit(0)).alias(f"c{i}") for i in range(1, len(tagged))],
        )
        labels = [(check, f"{table}({key})"), *(("orphans", name) for name in children)]
        out = [
            F.struct(F.lit(c).alias("check_name"), F.lit(s).alias("subject"), F.col(f"c{i}").alias("violations"))
            for i, (c, s) in enumerate(labels)
        ]
        found.append(totals.select(F.inline(F.array(*out))))
    return union_all(found)


def store_collisions(sites: DataFrame, key_type: str = "int") -> DataFrame:
    """DQ6: store numbers that several sites parse to, with the number of sites."""
    return (
        sites.select(
            store_number(F.col("storeNumber"), to=key_type).alias("storeNumber"), "siteID"
        )
        .filter(F.col("storeNumber").isNotNull())
        .groupBy("storeNumber")
        .agg(F.count_distinct("siteID").alias("sites"))
        .filter(F.col("sites") > 1)
    )


def bad_join_keys(sides: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """DQ9: rows whose join key is NULL or zero and so can never match, per side and key."""
    return union_all(
        [
            _counts(
                df, "bad_join_keys", {f"{s}.{k}": F.col(k).isNull() | (F.col(k) == 0) for k in keys}
            )
            for s, (df, keys) in sides.items()
        ]
    )
