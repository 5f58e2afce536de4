"""Classifiers and display labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import (
    FOLDER_TYPE,
    SERVICE_DEFAULT,
    SERVICE_RULES,
    TRASH_PARENT,
    UNKNOWN_DOCUMENT,
)

Rules = Sequence[tuple[str, Sequence[str]]]


def first_rule(text: Column, rules: Rules, default: str | None) -> Column:
    """Label of the first rule with a word contained in ``text``, ignoring case."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def hit(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])

    (label, words), *rest = rules
    chain = reduce(lambda c, r: c.when(hit(r[1]), r[0]), rest, F.when(hit(words), label))
    return chain.otherwise(F.lit(default))


def service_type(
    description: Column, rules: Rules = SERVICE_RULES, default: str = SERVICE_DEFAULT
) -> Column:
    return first_rule(description, rules, default)


def service_of_line(category: Column, description: Column, rules: Rules = SERVICE_RULES) -> Column:
    """The category when the line carries one, else the class of its description."""
    given = F.when(F.trim(category) != "", category)
    return F.coalesce(given, service_type(description, rules))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def document_kind(doc_type: Column) -> Column:
    return F.when(doc_type == FOLDER_TYPE, "FOLDER").otherwise("DOC")


def document_name(name: Column) -> Column:
    return F.when(is_blank(name), UNKNOWN_DOCUMENT).otherwise(name)


def document_location(parent: Column) -> Column:
    return (
        F.when(is_blank(parent), "")
        .when(parent == TRASH_PARENT, "(in: trash)")
        .otherwise(F.concat(F.lit("(in: "), F.substring(parent, 1, 8), F.lit("...)")))
    )


def document_line(kind: Column, name: Column, deleted: Column, location: Column) -> Column:
    return F.concat(
        F.lit("["), kind, F.lit("] "), name,
        F.when(deleted, " [DELETED]").otherwise(""),
        F.when(location == "", "").otherwise(F.concat(F.lit(" "), location)),
    )


def unparsed_line(file_name: Column) -> Column:
    return F.concat(F.lit("[?] "), file_name, F.lit(" (could not parse)"))
