"""Catalogue of JSON document metadata: one row per file, readable line included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import DOCUMENT_EXTENSIONS
from ..functions import labels

#: The fields that are used; others are not looked at.
_FIELDS = ("visibleName", "type", "parent", "createdTime", "lastModified", "lastOpened")
#: JSON values, as they are written, that count as false; numbers do if they are zero.
_FALSE = ("null", "false", '""', "[]", "{}")
_BLANKS = " \t\r\n"


def _true(json: Column) -> Column:
    """Whether a JSON value counts as true; a text does unless it is empty, whatever it says."""
    zero = F.coalesce(json.try_cast("double") == 0, F.lit(False))
    return F.coalesce(~json.isin(*_FALSE) & ~zero, F.lit(False))


def parse_documents(files: DataFrame) -> DataFrame:
    """Parses (file_name, text) rows; ``parsed`` tells whether the text was one JSON object.

    The parser is strict but stops behind the first value.  It is therefore given a list of the
    text and the text's hash: only if the text is one value and nothing else is the hash second.

    Values are parsed under a generator: a filter on one of them cannot be merged into the scan
    side, which would parse every text again for each condition.
    """
    own = F.md5("text")
    value = F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit(',"'), own, F.lit('"]')))
    begins = F.ltrim("text", F.lit(_BLANKS)).startswith("{")
    parsed = files.select("file_name", own.alias("_own"), begins.alias("_begins"), F.explode(F.array(value)).alias("_v"))
    alone = F.try_variant_get("_v", "$[1]", "string") == F.col("_own")
    text = {f: F.try_variant_get("_v", f"$[0].{f}", "string") for f in _FIELDS}
    return parsed.select(
        "file_name",
        F.coalesce(F.col("_begins") & alone, F.lit(False)).alias("parsed"),
        *[text[f].alias(f) for f in _FIELDS[:3]],
        _true(F.to_json(F.try_variant_get("_v", "$[0].deleted", "variant"))).alias("deleted"),
        F.timestamp_millis(text["createdTime"].try_cast("bigint")).alias("created_at"),
        F.timestamp_millis(text["lastModified"].try_cast("bigint")).alias("modified_at"),
        F.timestamp_millis(text["lastOpened"].try_cast("bigint")).alias("opened_at"),
    )


def document_summary(files: DataFrame) -> DataFrame:
    """Kind, name, state, location and display line of every document."""
    kind = labels.document_kind(F.col("type"))
    name = labels.document_name(F.col("visibleName"))
    location = labels.document_location(F.col("parent"))
    line = labels.document_line(kind, name, F.col("deleted"), location)
    ok = F.col("parsed")
    return parse_documents(files).select(
        "file_name",
        F.when(ok, kind).otherwise("?").alias("kind"),
        F.when(ok, name).alias("name"),
        F.when(ok, F.col("deleted")).alias("deleted"),
        F.when(ok, location).alias("location"),
        F.when(ok, line).otherwise(labels.unparsed_line(F.col("file_name"))).alias("line"),
    )


def name_search(files: DataFrame, needle: str) -> DataFrame:
    """Documents whose whole name contains ``needle``, ignoring case."""
    return (
        parse_documents(files)
        .filter(F.col("parsed") & F.lower("visibleName").contains(needle.lower()))
        .select(F.col("visibleName").alias("name"), "file_name")
    )


def extension_counts(
    files: DataFrame, extensions: Sequence[str] = DOCUMENT_EXTENSIONS
) -> DataFrame:
    """Files per known extension, zero included, and a total row over those extensions."""
    name = F.col("file_name")
    counted = files.agg(
        *[F.count_if(name.endswith(e)).alias(f"c{i}") for i, e in enumerate(extensions)]
    )
    each = [F.col(f"c{i}") for i in range(len(extensions))]
    rows = [
        F.struct(F.lit(e).alias("extension"), c.alias("files"))
        for e, c in zip(extensions, each, strict=True)
    ]
    total = F.struct(F.lit("total").alias("extension"), sum(each[1:], each[0]).alias("files"))
    return counted.select(F.inline(F.array(*rows, total)))
