"""Hierarchical area tables: programme blocks and massing against the site envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import lenient_area
from dossierlake.functions.text import blank_to_null
from dossierlake.operators import scan

CLOSE_SHARE = 0.995
_CLOSED = -1


def block_name(c) -> Column:
    """Leading decoration removed; a name made of decoration only stays."""
    t = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    cut = F.trim(F.regexp_replace(t, fixed.AREA_DECORATION, ""))
    return F.when(cut == "", t).otherwise(cut)


def is_subtotal(c) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c).rlike(fixed.AREA_SUBTOTAL)


def _prepared(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("row_type", F.coalesce(blank_to_null("row_type"), F.lit("space")))
        .withColumn("_sub", F.coalesce(lenient_area("subtotal_area"), lenient_area("area")))
        .withColumn("_area", lenient_area("area"))
    )


def _site_row() -> Column:
    return (F.col("row_type") == "site_total") & F.coalesce(F.col("name").contains("부지"), F.lit(False))


def _owned(rows: DataFrame, doc: list[str], ordinal: str, hot: bool) -> DataFrame:
    """Rows with the heading they stand below: a site where the document has sites, else a
    facility. Totals and headings of another kind close the open one (``_CLOSED``)."""
    flagged = scan.group_any(_prepared(rows), doc, _site_row(), "multi", hot=hot)
    total, facility = F.col("row_type") == "site_total", F.col("row_type") == "facility"
    opens = F.when(F.col("multi"), F.when(_site_row(), F.col(ordinal)).when(total, F.lit(_CLOSED))).otherwise(
        F.when(facility, F.col(ordinal)).when(total, F.lit(_CLOSED))
    )
    placed = scan.carry_last(flagged, doc, ordinal, {"owner": opens}, hot=hot)
    return placed.withColumn("owner", F.coalesce("owner", F.lit(_CLOSED)))


def _open_facilities(owned: DataFrame, doc: list[str], ordinal: str, hot: bool) -> DataFrame:
    """Summary facilities below each site heading, until the declared total is reached.

    A detail row also ends a site. The sum before a row only grows, so "not yet closed" is
    the same as "sum before the row is short of the target".
    """
    placed = owned.filter(F.col("multi") & (F.col("owner") >= 0))
    site = [*doc, "owner"]
    total, facility = F.col("row_type") == "site_total", F.col("row_type") == "facility"
    running = scan.carry_last(
        placed, site, ordinal,
        {"_target": F.when(total, F.col("_sub")), "_detail": F.when(~(total | facility), F.lit(True))}, hot=hot,
    ).filter(facility & F.col("_sub").isNotNull() & F.col("_detail").isNull())
    summed = scan.running_sum(running, site, ordinal, F.col("_sub"), "_before", before=True, hot=hot)
    is_open = F.col("_target").isNull() | (F.col("_before") < F.col("_target") * CLOSE_SHARE)
    return summed.filter(is_open).select(
        *doc, F.col("owner").alias("site"), ordinal,
        F.coalesce(blank_to_null("name"), F.lit("시설")).alias("name"), F.col("_sub").alias("area"),
    )


def _facility_blocks(owned: DataFrame, doc: list[str], ordinal: str) -> DataFrame:
    """Facilities of tables without sites: subtotal, else the sum of the spaces below. Rows
    above the first facility are blocks of their own."""
    own, space = F.col("row_type") == "facility", F.col("row_type") == "space"
    below = F.col("owner") >= 0
    single = owned.filter(~F.col("multi") & (F.col("row_type") != "site_total")).withColumn(
        "_block", F.when(below, F.col("owner")).otherwise(F.col(ordinal))
    )
    name = F.coalesce(blank_to_null("name"), F.when(own, F.lit("시설")).otherwise(F.lit("기타")))
    blocks = single.groupBy(*doc, "_block").agg(
        F.min_by(name, F.when(own | ~below, F.col(ordinal))).alias("name"),
        F.coalesce(F.max(F.when(own, F.col("_sub"))), F.sum(F.when(space | ~below, F.col("_area")))).alias("area"),
    )
    return blocks.filter(F.col("area") > 0).select(*doc, F.col("_block").alias(ordinal), "name", "area")


def site_facilities(rows: DataFrame, doc: list[str], ordinal: str = "ord", hot: bool | None = None) -> DataFrame:
    """Summary facilities (doc, site, name, area) of tables with site headings."""
    hot = scan.is_hot(rows, doc) if hot is None else hot
    return _open_facilities(_owned(rows, doc, ordinal, hot), doc, ordinal, hot)


def facility_totals(rows: DataFrame, doc: list[str], ordinal: str = "ord", hot: bool | None = None) -> DataFrame:
    """Blocks (doc, name, area) of tables without site headings."""
    hot = scan.is_hot(rows, doc) if hot is None else hot
    return _facility_blocks(_owned(rows, doc, ordinal, hot), doc, ordinal)


def programme_blocks(rows: DataFrame, doc: list[str], ordinal: str = "ord", hot: bool | None = None, most: int | None = None) -> DataFrame:
    """Blocks (name, area) of every document with at least two: no subtotals, equal names merged.
    With ``most``, the smallest are collected in one block where there are more than that."""
    hot = scan.is_hot(rows, doc) if hot is None else hot
    owned = _owned(rows, doc, ordinal, hot)
    raw = (
        _open_facilities(owned, doc, ordinal, hot).select(*doc, ordinal, "name", "area")
        .unionByName(_facility_blocks(owned, doc, ordinal))
    )
    clean = raw.withColumn("name", block_name("name")).filter(~is_subtotal("name"))
    merged = clean.groupBy(*doc, "name").agg(F.sum("area").alias("area"), F.min(ordinal).alias("place"))
    # per document: the largest blocks, ranked by a limit that also applies before the shuffle
    totals = merged.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("area").alias("total")
    ).filter(F.col("_n") >= 2)
    order = Window.partitionBy(*doc).orderBy(F.desc("area"), "place")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    if most is None:
        return ranked.join(totals, doc).select(*doc, "name", "area", "rank", "total")
    top = ranked.filter(F.col("rank") <= most)
    shown = top.join(totals, doc).filter((F.col("_n") <= most) | (F.col("rank") < most))
    kept_sum = F.sum("area").over(Window.partitionBy(*doc))  # at most ``most`` rows per document
    summed = shown.withColumn("_kept", kept_sum)
    block = F.struct("name", "area", "rank")
    rest = F.struct(
        F.concat(F.lit("기타 "), F.col("_n") - (most - 1), F.lit("개")).alias("name"),
        (F.col("total") - F.col("_kept")).alias("area"),
        F.lit(most).alias("rank"),
    )
    is_last = (F.col("_n") > most) & (F.col("rank") == most - 1)
    emitted = F.when(is_last, F.array(block, rest)).otherwise(F.array(block))
    return summed.select(*doc, "total", F.inline(emitted)).select(*doc, "name", "area", "rank", "total")


def hierarchy_stats(rows: DataFrame, doc: list[str]) -> DataFrame:
    """Rows and filled areas per row type."""
    return rows.groupBy(*doc, "row_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("area").alias("area_filled")
    )


#: Row types that form the hierarchy of an area table.
LEVELS = ("site_total", "facility", "division", "bureau", "space")


def hierarchy_summary(rows: DataFrame, shared: DataFrame, doc: list[str]) -> DataFrame:
    """Per document: filled areas, the hierarchy's levels that occur, and entries of shared areas
    (``shared`` has one row each)."""
    found = rows.groupBy(*doc).agg(
        F.count("area").alias("area_filled"),
        F.array_sort(F.collect_set(F.when(F.col("row_type").isin(*LEVELS), F.col("row_type")))).alias("levels"),
    )
    entries = shared.groupBy(*doc).agg(F.count(F.lit(1)).alias("_shared"))
    return found.join(entries, doc, "left").select(*doc, "area_filled", "levels", F.coalesce("_shared", F.lit(0)).alias("shared"))


def site_envelopes(sites: DataFrame, buckets: DataFrame, doc: list[str]) -> DataFrame:
    """Programme of every site against the floor area its limits allow.

    ``sites`` has doc, ord and the limits; ``buckets`` has doc, ord (of the bucket), name,
    area. Both are numbered in order and matched by place.
    """
    usable = (F.col("area") > 0) & (F.col("bcr") > 0) & (F.col("far") > 0)
    hot = scan.is_hot(buckets, doc)
    placed_sites = scan.positions(sites.filter(usable), doc, "ord", "ord", name="place")
    clean = buckets.filter(F.col("area") > 0).withColumn("name", block_name("name")).filter(~is_subtotal("name"))
    below = F.col("name").rlike(r"지\s*하")
    sums = clean.groupBy(*doc, "ord").agg(
        F.coalesce(F.sum(F.when(~below, F.col("area"))), F.lit(0.0)).alias("ground_est"),
        F.coalesce(F.sum(F.when(below, F.col("area"))), F.lit(0.0)).alias("under_sum"),
    )
    placed = scan.positions(sums, doc, "ord", "ord", name="place", hot=hot).drop("ord")
    by_far = F.col("far") / F.col("bcr")
    by_height = F.when(F.col("h_limit") > 0, F.col("h_limit") / fixed.FLOOR_HEIGHT_M)
    joined = (
        placed_sites.drop("ord").join(placed, [*doc, "place"])
        .withColumn("footprint", F.col("area") * F.col("bcr") / 100.0)
        .withColumn("floors", F.coalesce(F.least(by_far, by_height), by_far))
        .withColumn(
            "binding",
            F.when(by_height.isNull() | (by_far <= by_height), F.lit("용적률")).otherwise(F.lit("높이한도")),
        )
    )
    return (
        joined.withColumn("cap", F.col("footprint") * F.col("floors"))
        .withColumn("over", F.greatest(F.col("ground_est") - F.col("cap"), F.lit(0.0)))
        .withColumn("fill", F.col("ground_est") / F.nullif(F.col("cap"), F.lit(0.0)))
    )
