"""Checklist of a brief as ordered long tables, one per sheet.

Every line has sheet, part (0 summary, 1 items, 2 total), ord, label, text and amount, and a sheet is
read by (part, ord). Labels are kept apart from layout: nothing here is formatted. Null documents
are one document; a sheet without rows has no lines, but for the warnings, which say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.operators import scan

# fixed values: sheet names, levels of an area row with their labels, labels of severities
SCORING, REQUIREMENTS, WARNINGS, AREAS = "2.심사기준", "3.요구사항", "4.검증경고", "5.면적표상세"
LEVELS = {"site_total": (0, "부지"), "facility": (1, "시설"), "bureau": (2, "영역"), "division": (3, "과"), "space": (4, "세부")}
SEVERITIES = {"high": (0, "높음"), "medium": (1, "보통"), "low": (2, "낮음")}
NO_WARNING = "검출된 경고 없음"


def _line(doc: list[str], sheet: str, part: int, ordinal, label, text, amount) -> list[Column | str]:
    return [
        *doc, F.lit(sheet).alias("sheet"), F.lit(part).alias("part"), ordinal.cast("long").alias("ord"),
        label.cast("string").alias("label"), text.cast("string").alias("text"), amount.cast("double").alias("amount"),
    ]


def _of(table: dict, key: Column, place: int, other: Column) -> Column:
    found = F.lit(None)
    for name, values in reversed(table.items()):
        found = F.when(key == name, F.lit(values[place])).otherwise(found)
    return F.coalesce(found, other)


def scoring_sheet(rows: DataFrame, doc: list[str], hot: int | bool | None = None) -> DataFrame:
    """Criteria (ord, category, detail, points) and their total. A category that the row before has
    as well is named once, as merged cells show it."""
    before = scan.previous(rows, doc, "ord", {"_category": F.col("category")}, hot=hot)
    named = F.when(~F.coalesce(F.col("category").eqNullSafe(F.col("_category")) & F.col("category").isNotNull(), F.lit(False)), F.col("category"))
    items = before.select(*_line(doc, SCORING, 1, F.col("ord"), named, F.col("detail"), F.col("points")))
    total = rows.groupBy(*doc).agg(F.sum(F.col("points").cast("decimal(28,6)")).alias("_sum"))
    return items.unionByName(total.select(*_line(doc, SCORING, 2, F.lit(0), F.lit("합계"), F.lit(None), F.col("_sum"))))


def requirement_sheet(rows: DataFrame, doc: list[str]) -> DataFrame:
    """Requirements (ord, axis, description, weight) in their order."""
    return rows.select(*_line(doc, REQUIREMENTS, 1, F.col("ord"), F.coalesce("axis", F.lit("")), F.coalesce("description", F.lit("")), F.col("weight")))


def warning_sheet(docs: DataFrame, flags: DataFrame, doc: list[str]) -> DataFrame:
    """Counts by severity, then the flags (ord, severity, message), gravest first; unknown severities
    come last under their own name. Documents without a flag get a line that says so.

    ``part`` is 1 for high, 2 for medium and 3 for all others, so no sort of a document is needed.
    """
    severity = F.coalesce("severity", F.lit("low"))
    counts = flags.groupBy(*doc).agg(*[F.count_if(severity == s).alias(f"_{s}") for s in SEVERITIES], F.lit(True).alias("_any"))
    known = docs.select(*doc).distinct().alias("l").join(counts.alias("r"), scan.same_key(doc), "left").select("l.*", *[f"r._{s}" for s in SEVERITIES], "r._any")
    summary = known.select(
        "*", F.explode(F.array(*[F.struct(F.lit(place).alias("o"), F.lit(label).alias("l"), F.coalesce(f"_{s}", F.lit(0)).alias("n")) for s, (place, label) in SEVERITIES.items()])).alias("c")
    ).select(*_line(doc, WARNINGS, 0, F.col("c.o"), F.col("c.l"), F.lit(None), F.col("c.n")))
    none = known.where(F.col("_any").isNull()).select(*_line(doc, WARNINGS, 1, F.lit(0), F.lit(None), F.lit(NO_WARNING), F.lit(None)))
    items = flags.select(*_line(doc, WARNINGS, 1, F.col("ord"), _of(SEVERITIES, severity, 1, severity), F.coalesce("message", F.lit("")), F.lit(None)), severity.alias("_s"))
    items = items.withColumn("part", (_of(SEVERITIES, F.col("_s"), 0, F.lit(2)) + 1).cast("int")).drop("_s")
    return summary.unionByName(none).unionByName(items)


def area_sheet(rows: DataFrame, doc: list[str]) -> DataFrame:
    """Area rows (ord, row_type, name, area, subtotal_area) with the label of their level, the name
    indented by two blanks a level; an unknown level counts as the lowest."""
    kind = F.coalesce("row_type", F.lit("space"))
    level, label = _of(LEVELS, kind, 0, F.lit(4)), _of(LEVELS, kind, 1, F.lit(LEVELS["space"][1]))
    name = F.concat(F.repeat(F.lit(" "), level * 2), F.coalesce("name", F.lit("")))
    return rows.select(*_line(doc, AREAS, 1, F.col("ord"), label, name, F.coalesce("area", "subtotal_area")))


def checklist(docs: DataFrame, scoring: DataFrame, requirements: DataFrame, flags: DataFrame, areas: DataFrame, doc: list[str]) -> dict[str, DataFrame]:
    """The sheets by name, ready for ``upserts.export_sheets``."""
    return {
        SCORING: scoring_sheet(scoring, doc), REQUIREMENTS: requirement_sheet(requirements, doc),
        WARNINGS: warning_sheet(docs, flags, doc), AREAS: area_sheet(areas, doc),
    }
