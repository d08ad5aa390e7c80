"""Categorical column expressions: grades, floors, programme categories, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.text import any_of, col


def lookup(c, table: dict, default=None) -> Column:
    """A fixed table as a CASE expression: no join, nothing to broadcast."""
    out = None
    for key, value in table.items():
        out = F.when(col(c) == key, F.lit(value)) if out is None else out.when(
            col(c) == key, F.lit(value)
        )
    return out.otherwise(default) if default is not None else out


def resolve_grade(grade, score=None, overall_grade=None, overall_score=None) -> Column:
    """Letter grade, else the legacy word, else the score band, else NULL."""
    g = F.nullif(col(grade), F.lit(""))
    if overall_grade is not None:
        g = F.coalesce(g, F.nullif(col(overall_grade), F.lit("")))
    out = F.when(g.isin("A", "B", "C", "D", "E"), g)
    for word, letter in fixed.LEGACY_GRADES.items():
        out = out.when(g == word, F.lit(letter))
    if score is None:
        return out
    s = col(score)
    if overall_score is not None:
        s = F.coalesce(s, col(overall_score))
    s = s.try_cast("double")
    for letter, floor in fixed.GRADE_BANDS:
        out = out.when(s >= floor, F.lit(letter))
    return out.when(s.isNotNull(), F.lit("E"))


def grade_label(c) -> Column:
    return lookup(c, fixed.GRADE_LABELS, F.lit(""))


def floor_order(c) -> Column:
    """ROOF 10000, basement n -> -n, storey n -> n, NULL when unreadable."""
    s = F.upper(F.trim(col(c)))
    below = F.regexp_extract(s, r"(?:B\s*|지하\s*)(\d+)", 1).try_cast("int")
    storey = F.regexp_extract(s, r"(\d+\s*[F층]|지상\s*\d+)", 1)
    above = F.regexp_extract(storey, r"(\d+)", 1).try_cast("int")
    roof = s.rlike(r"ROOF|옥상|PENTHOUSE|^PH\d?$")
    return F.coalesce(F.when(roof, F.lit(10000)), -below, F.nullif(above, F.lit(0)))


def floor_label(order) -> Column:
    o = col(order)
    return (
        F.when(o == 10000, F.lit("ROOF"))
        .when(o < 0, F.concat(F.lit("B"), (-o).cast("string")))
        .when(o > 0, F.concat(o.cast("string"), F.lit("F")))
    )


def programme_category(c) -> Column:
    """First group in order with a word inside the upper-cased text."""
    upper = F.upper(col(c))
    out = None
    for name, words in fixed.PROGRAM_CATEGORIES.items():
        hit = upper.rlike(any_of([w.upper() for w in words]))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("other"))


def anonymous_label(pos) -> Column:
    """A안 .. Z안, then 안27, 안28 ..."""
    p = col(pos)
    return F.when(p <= 26, F.concat(F.char(p.cast("long") + 64), F.lit("안"))).otherwise(
        F.concat(F.lit("안"), p.cast("string"))
    )


def effective_label(article_date, edition_date) -> Column:
    """Article date, else the edition date named as such, else ''."""
    from dossierlake.functions.text import legal_date

    article, edition = legal_date(article_date), legal_date(edition_date)
    return (
        F.when(article != "", F.concat(F.lit("시행 "), article))
        .when(edition != "", F.concat(F.lit("법규 시행 "), edition))
        .otherwise(F.lit(""))
    )
