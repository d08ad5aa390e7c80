"""Column expressions over nested records in JSON, whatever their depth. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.text import col

# a quote inside a string is written with a backslash, so this text can only be a key and its value
_PAGE = r'(?<!\\)"_page":(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false)'


def canonical(json: Column | str) -> Column:
    """One text for equal records: keys sorted at every level, no blanks; NULL for what is no JSON."""
    return F.to_json(F.try_parse_json(col(json)))


def page_numbers(json: Column | str) -> Column:
    """Every number under a key ``_page``, at any depth, as whole numbers; other values there are
    searched like any other. A truth value counts as 1 or 0."""
    found = F.regexp_extract_all(canonical(json), F.lit(_PAGE), F.lit(1))
    return F.transform(found, lambda n: F.when(n == "true", 1).when(n == "false", 0).otherwise(n.cast("double").cast("long")))


def page_bound(json: Column | str) -> Column:
    """Last valid page of a record: its positive ``total_pages``, else the largest page seen in it."""
    stated = F.try_variant_get(F.try_parse_json(col(json)), "$.total_pages", "double")
    return F.coalesce(F.when(stated > 0, stated.cast("long")), F.array_max(page_numbers(json)))
