"""Health checks over stored comparisons, patterns and page routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import ratio
from dossierlake.functions.text import leaf

# fixed value: citations as the audit reads them
AUDIT_CITATION = r"\(p\.?\s*([0-9][0-9,\s]*|\?)\)"


def comparison_drift(
    items: DataFrame, cells: DataFrame, comparisons: DataFrame, totals: DataFrame, keys: list[str]
) -> DataFrame:
    """Format, citation coverage, citations out of range and missing parts per comparison.

    ``items`` has keys, company, text (one strength or weakness per row); ``cells`` has keys,
    ord, grade, score; ``comparisons`` has keys, has_gap, rubric_version; ``totals`` has
    keys, company, total_pages. The last cell that states a grade or score sets the format.
    """
    found = F.regexp_extract_all("text", F.lit(AUDIT_CITATION), F.lit(1))
    numbers = F.flatten(F.transform(found, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1))))
    beyond = F.filter(numbers, lambda n: n.try_cast("long") > F.col("total_pages"))
    cited = items.join(totals, [*keys, "company"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.size(found)).alias("citations"),
        F.sum(F.when(F.col("total_pages") > 0, F.size(beyond)).otherwise(0)).alias("out_of_range"),
    )
    kind = F.when(F.col("grade").isNotNull(), F.lit("grade")).when(F.col("score").isNotNull(), F.lit("score"))
    formats = cells.groupBy(*keys).agg(
        F.max_by(kind, F.when(kind.isNotNull(), F.col("ord"))).alias("format")
    )
    joined = comparisons.join(formats, keys, "left").join(cited, keys, "left")
    n = F.coalesce("items", F.lit(0))
    coverage = F.coalesce(ratio(F.lit(100.0) * F.coalesce("citations", F.lit(0)), n), F.lit(0.0))
    return joined.select(
        *keys,
        F.coalesce("format", F.lit("?")).alias("format"),
        n.alias("items"),
        F.coalesce("citations", F.lit(0)).alias("citations"),
        F.coalesce("out_of_range", F.lit(0)).alias("out_of_range"),
        coverage.alias("coverage_pct"),
        F.coalesce(F.col("format") == "score", F.lit(False)).alias("old_format"),
        (coverage < 50).alias("low_coverage"),
        (~F.coalesce(F.col("has_gap"), F.lit(False))).alias("no_gap_analysis"),
        F.col("rubric_version").isNull().alias("no_rubric_version"),
    )


def sample_audit(pattern: DataFrame) -> DataFrame:
    """Facilities whose measures rest on unequal samples or on fewer than three winners."""
    measures = pattern.filter((F.col("family") == "quantitative") & (F.col("cohort") == "win"))
    spread = measures.groupBy("facility_type").agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n")
    )
    wins = pattern.filter((F.col("family") == "count") & (F.col("cohort") == "win")).select(
        "facility_type", F.col("n").alias("win_count")
    )
    return wins.join(spread, "facility_type", "left").select(
        "facility_type", "win_count", "min_n", "max_n",
        F.coalesce(F.col("min_n") < F.col("max_n"), F.lit(False)).alias("unequal"),
        (F.col("win_count") < 3).alias("too_few"),
    )


def routing_audit(
    entries: DataFrame, pages: DataFrame, doc: list[str], required: dict[str, str], scopes: list[str]
) -> DataFrame:
    """Design pages with their own guideline groups, merged pages, and whether leaf names lie
    under the path they belong to.

    ``entries`` has doc, page, facility_scope, path; ``pages`` has doc, page, primary_type,
    merged; ``required`` maps leaf name -> path marker.
    """
    design = pages.filter(F.col("primary_type").isin(fixed.DESIGN_TYPES))
    own = entries.select(*doc, "page").distinct().withColumn("_own", F.lit(True))
    base = design.join(own, [*doc, "page"], "left").groupBy(*doc).agg(
        F.count(F.lit(1)).alias("design_pages"),
        F.count("_own").alias("with_groups"),
        F.count_if("merged").alias("merged_pages"),
    )
    name = leaf("path")
    ok = F.lit(False)
    for word, marker in required.items():
        ok = ok | ((name == word) & F.col("path").contains(marker))
    hits = entries.filter(name.isin(list(required))).groupBy(*doc).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(~(ok & F.col("facility_scope").isin(scopes))).alias("misrouted"),
    )
    return base.join(hits, doc, "left").fillna(0, ["hits", "misrouted"])
