"""Numeric column expressions: coercion, rounding, tolerance, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.text import col

HUNDRED_MILLION = 1e8


def half_even(c, digits: int = 0) -> Column:
    """Banker's rounding; the single place that decides how results are rounded."""
    return F.bround(col(c), digits)


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0 or missing."""
    return col(a) / F.nullif(col(b), F.lit(0).cast("double"))


def spread(c) -> Column:
    """Sample standard deviation; 0 for a single value, NULL for none."""
    return F.when(F.count(col(c)) > 1, F.stddev_samp(col(c))).when(
        F.count(col(c)) == 1, F.lit(0.0)
    )


def strict_number(variant) -> Column:
    """Number of a VARIANT; text and booleans are not numbers."""
    v = col(variant)
    kind = F.schema_of_variant(v)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def lenient_area(c) -> Column:
    """First number inside a text such as '12,345.6 ㎡'; NULL unless positive."""
    raw = F.regexp_extract(col(c).cast("string"), r"(-?\d[\d,]*\.?\d*)", 1)
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(value > 0, value)


def loose_number(c) -> Column:
    """Cast to double, NULL when the text is no number."""
    return F.nullif(col(c).cast("string"), F.lit("")).try_cast("double")


def money_label(c) -> Column:
    """Won amount in 조 / 억 / 만 units."""
    v = F.abs(col(c))
    sign = F.when(col(c) < 0, F.lit("-")).otherwise(F.lit(""))
    text = (
        F.when(v >= 1e12, F.concat(F.format_number(v / 1e12, 1), F.lit("조")))
        .when(v >= HUNDRED_MILLION, F.concat(F.format_number(v / HUNDRED_MILLION, 0), F.lit("억")))
        .when(v >= 1e4, F.concat(F.format_number(v / 1e4, 0), F.lit("만")))
        .otherwise(F.concat(F.format_number(v, 0), F.lit("원")))
    )
    return F.concat(sign, text)


def percent_label(c) -> Column:
    return F.concat(F.format_string("%.1f", col(c)), F.lit("%"))


def plain_amount(c, unit: str = "") -> Column:
    """Thousands separators; one decimal only when the value is not whole."""
    v = col(c)
    text = F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 1))
    return F.when(v.isNull(), F.lit("")).otherwise(F.concat(text, F.lit(unit)))


def absolute_error(pred, truth) -> Column:
    return F.abs(col(pred) - col(truth))


def relative_error(pred, truth) -> Column:
    """abs error over abs truth; infinite when the truth is 0 and the error is not."""
    err = absolute_error(pred, truth)
    return F.when(col(truth) != 0, err / F.abs(F.nullif(col(truth), F.lit(0.0)))).when(
        err == 0, F.lit(0.0)
    ).when(err.isNotNull(), F.lit(float("inf")))
