"""Page classification rules, completeness, routing, runs and per-type merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.labels import lookup
from dossierlake.operators import scan


def submission_type(kind: str = "type", confidence: str = "confidence") -> Column:
    """Unknown types become the default; doubtful strict types fall back."""
    known = F.when(F.col(kind).isin(fixed.PAGE_TYPES), F.col(kind)).otherwise(
        F.lit(fixed.DEFAULT_PAGE_TYPE)
    )
    doubtful = F.coalesce(F.col(confidence), F.lit(0.0)) < fixed.STRICT_CONFIDENCE_FLOOR
    return F.when(
        doubtful & known.isin(list(fixed.STRICT_FALLBACK)), lookup(known, fixed.STRICT_FALLBACK)
    ).otherwise(known)


def brief_type(
    kind: str = "type", has_scoring: str = "has_scoring_table", header: str = "page_header_text"
) -> Column:
    """Brief page type after promotion, demotion and the two header rules, in that order."""
    scoring = F.coalesce(F.col(has_scoring), F.lit(False))
    title = F.trim(F.coalesce(F.col(header), F.lit("")))
    known = F.when(F.col(kind).isin(fixed.BRIEF_PAGE_TYPES), F.col(kind)).otherwise(
        F.lit(fixed.DEFAULT_BRIEF_PAGE_TYPE)
    )
    tabled = (
        F.when(scoring & ~known.isin("BRIEF_EVALUATION", "BRIEF_PROGRAM"), F.lit("BRIEF_EVALUATION"))
        .when(~scoring & (known == "BRIEF_EVALUATION"), F.lit("BRIEF_ADMIN"))
        .otherwise(known)
    )
    never = title.rlike("(?U)" + "|".join(fixed.NOT_SCORING_HEADER))
    form = title.rlike("(?U)" + "|".join(fixed.FORM_HEADER))
    return (
        F.when((tabled == "BRIEF_EVALUATION") & never, F.lit("BRIEF_ADMIN"))
        .when((tabled == "BRIEF_PROJECT_INFO") & form, F.lit("BRIEF_SUBMISSION"))
        .otherwise(tabled)
    )


def extraction_route(
    kind: str = "primary_type",
    confidence: str = "confidence",
    digital_chars: str = "digital_chars",
    ocr_chars: str = "ocr_chars",
    brief: bool = False,
) -> Column:
    """skip, digital, ocr, tiled or vision: the cheapest reader that is good enough."""
    t, conf = F.col(kind), F.coalesce(F.col(confidence), F.lit(1.0))
    tiled = t.isin(fixed.TILED_TYPES) & (conf >= fixed.TILED_CONFIDENCE)
    effective = F.when(
        t.isin(fixed.TILED_TYPES) & (conf < fixed.TILED_CONFIDENCE), F.lit(fixed.DEFAULT_PAGE_TYPE)
    ).otherwise(t)
    digital = F.coalesce(F.col(digital_chars), F.lit(0)) >= fixed.OCR_MIN_CHARS
    ocr = F.coalesce(F.col(ocr_chars), F.lit(0)) >= fixed.OCR_MIN_CHARS
    known = fixed.PAGE_TYPES + (fixed.BRIEF_PAGE_TYPES if brief else [])
    skipped = t.isin(fixed.LOWEST_PRIORITY_TYPES + fixed.SKIPPED_TYPES) | ~t.isin(known)
    return (
        F.when(skipped, F.lit("skip"))
        .when(digital & ~effective.isin(fixed.NO_DIGITAL_TEXT_TYPES), F.lit("digital"))
        .when(ocr & effective.isin(fixed.OCR_FIRST_TYPES), F.lit("ocr"))
        .when(tiled & F.lit(not brief), F.lit("tiled"))
        .otherwise(F.lit("vision"))
    )


def route_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages per route, for cost planning."""
    return pages.groupBy(*keys, "route").agg(F.count(F.lit(1)).alias("pages"))


def first_per_page(cls: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """First classification of a page wins; a partial aggregate, so hot documents stay split."""
    rest = [c for c in cls.columns if c not in keys]
    packed = cls.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_p"))
    return packed.select(*keys, "_p.*")


def last_per_page(ext: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """Last extraction of a page wins."""
    rest = [c for c in ext.columns if c not in keys]
    packed = ext.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_p"))
    return packed.select(*keys, "_p.*")


def classified_extractions(
    cls: DataFrame, ext: DataFrame, keys: list[str], cls_ordinal: Column, ext_ordinal: Column
) -> DataFrame:
    """Every classified page with its extraction, if any."""
    left = first_per_page(cls, keys, cls_ordinal)
    right = last_per_page(ext, keys, ext_ordinal)
    return left.join(right, keys, "left")


def wrap_array(payload: str = "data") -> Column:
    """An array payload is wrapped as {"_items": [...]}; objects stay as they are."""
    text = F.col(payload)
    return F.when(
        F.ltrim(text).startswith("["), F.concat(F.lit('{"_items":'), text, F.lit("}"))
    ).otherwise(text)


def merge_by_type(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """Per document and type: page count, first and last page. Payload rows stay long."""
    return pages.groupBy(*doc, "primary_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(page).alias("first_page"),
        F.max(page).alias("last_page"),
    )


def type_members(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """The pages of every (document, type), numbered in page order."""
    return scan.positions(pages, [*doc, "primary_type"], page, page, name="seq")


def page_spine(docs: DataFrame, results: DataFrame, doc: list[str], ordinal: Column) -> DataFrame:
    """Pages 1..N of every document; a page without result gets the default row.

    ``docs`` has total_pages, ``results`` has page, primary_type and confidence. Duplicate
    results keep the last one.
    """
    spine = docs.filter(F.col("total_pages") > 0).select(
        *doc, F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page")
    )
    keys = [*doc, "page"]
    kept = last_per_page(results.select(*keys, "primary_type", "confidence", ordinal.alias("_o")),
                         keys, F.col("_o")).drop("_o")
    found = kept.withColumn("_found", F.lit(True))
    return (
        spine.join(found, keys, "left")
        .withColumn("primary_type", F.coalesce("primary_type", F.lit(fixed.DEFAULT_PAGE_TYPE)))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("defaulted", F.col("_found").isNull())
        .drop("_found")
    )


def contiguous_runs(
    pages: DataFrame, doc: list[str], page: str = "page", kind: str = "primary_type"
) -> DataFrame:
    """Consecutive pages of the same type form a group."""
    same = (F.col("_before_kind") == F.col(kind)) & (F.col("_before_page") + 1 == F.col(page))
    numbered = scan.runs(
        pages, doc, page, same, {"_before_kind": F.col(kind), "_before_page": F.col(page)}
    )
    return numbered.groupBy(*doc, "run", kind).agg(
        F.min(page).alias("first_page"), F.max(page).alias("last_page"),
        F.count(F.lit(1)).alias("pages"),
    )


def design_runs(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """Groups of consecutive design pages; other pages between them do not matter."""
    return contiguous_runs(pages.filter(F.col("primary_type").isin(fixed.DESIGN_TYPES)), doc, page)


def scoring_stack(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """Scoring pages plus the page after each when that page may hold the table's tail."""
    scoring = pages.filter(F.col("primary_type") == "BRIEF_EVALUATION")
    tail = pages.filter(F.col("primary_type").isin(fixed.SCORING_TAIL_TYPES)).join(
        scoring.select(*doc, (F.col(page) + 1).alias(page)), [*doc, page], "left_semi"
    )
    return scoring.select(*doc, page, "primary_type", F.lit(False).alias("is_tail")).unionByName(
        tail.select(*doc, page, "primary_type", F.lit(True).alias("is_tail"))
    )


def is_low(confidence: str, floor: float = 0.55) -> Column:
    return F.col(confidence) < floor


def low_confidence(pages: DataFrame, floor: float = 0.55) -> DataFrame:
    return pages.filter(is_low("confidence", floor))


def form_pages(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """Programme pages that belong to a submission form; the state carries over pages.

    ``pages`` has page_header_text; a blank form is opened by its header and closed by a
    numbered heading or the programme heading.
    """
    header = F.coalesce(F.col("page_header_text"), F.lit(""))
    state = F.when(header.contains("서식"), F.lit(True)).when(
        header.rlike(r"^\s*\d+\s*[.\-]") | header.contains("공간구성"), F.lit(False)
    )
    carried = scan.carry_last(pages, doc, page, {"in_form": state})
    return carried.filter(F.coalesce("in_form", F.lit(False))).drop("in_form")
