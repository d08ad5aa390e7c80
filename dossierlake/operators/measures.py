"""Numeric measures: consistency rules, exclusion of flagged fields, comparison to cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import half_even, spread
from dossierlake.functions.text import nonzero

FLAG_TYPE = "array<struct<rule:string,severity:string,fields:array<string>,stated:double,expected:double>>"


def _flag(when: Column, rule: str, severity: str, fields: list[str], stated, expected) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            F.array(*[F.lit(f) for f in fields]).alias("fields"),
            F.lit(stated).cast("double").alias("stated"),
            F.lit(expected).cast("double").alias("expected"),
        ),
    )


def consistency_flags() -> Column:
    """All violated identities and bounds of one row of measures, as an array of flags.

    A missing input skips its rule; an area of 0 counts as missing. Values are not changed.
    """
    site, building = nonzero("site_area_sqm"), nonzero("building_area_sqm")
    total, above = nonzero("total_floor_area_sqm"), nonzero("area_above_ground_sqm")
    coverage, far = F.col("building_coverage_ratio_pct"), F.col("floor_area_ratio_pct")
    implied_coverage = F.lit(100.0) * building / site
    implied_far = F.lit(100.0) * above / site
    implied_above = far / 100.0 * site
    exact_far = site.isNotNull() & far.isNotNull() & above.isNotNull()
    rules = [
        _flag(building > site * fixed.BUILDING_SITE_SLACK, "building_gt_site", "error",
              ["building_area_sqm", "site_area_sqm"], building, site),
        _flag(F.abs(implied_coverage - coverage) > fixed.COVERAGE_TOLERANCE_PP,
              "coverage_mismatch", "error",
              ["building_coverage_ratio_pct", "building_area_sqm", "site_area_sqm"],
              coverage, implied_coverage),
        _flag(exact_far & (F.abs(implied_far - far) > fixed.FAR_TOLERANCE_PP),
              "far_above_ground_mismatch", "error",
              ["floor_area_ratio_pct", "area_above_ground_sqm", "site_area_sqm"],
              far, implied_far),
        _flag(~exact_far & (total < implied_above * fixed.FLOOR_AREA_SLACK),
              "floor_area_below_far_implied", "error",
              ["total_floor_area_sqm", "floor_area_ratio_pct", "site_area_sqm"],
              total, implied_above),
    ]
    for field, (low, high) in fixed.MEASURE_BOUNDS.items():
        v = F.col(field)
        limit = F.when(v < low, F.lit(low)).otherwise(F.lit(high)).cast("double")
        rules.append(_flag(~v.between(low, high), "out_of_bounds", "error", [field], v, limit))
    rules.append(_flag(coverage > far + 1, "coverage_gt_far", "warn",
                       ["building_coverage_ratio_pct", "floor_area_ratio_pct"], coverage, far))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def measure_flags(quant: DataFrame, keys: list[str]) -> DataFrame:
    """One row per violated rule."""
    return quant.select(*keys, F.inline(consistency_flags()))


def clean_values(
    quant: DataFrame, keys: list[str], fields: list[str] | None = None, stored_flags: str | None = None
) -> DataFrame:
    """Long (keys, field, value) without nulls and without fields named by an error flag.

    Flags and the unpivot are computed inside the row, so nothing is shuffled. Stored flags,
    even an empty list, take precedence over recomputed ones.
    """
    fields = fields or fixed.STAT_MEASURES
    flags = consistency_flags()
    if stored_flags:
        flags = F.coalesce(F.col(stored_flags).cast(FLAG_TYPE), flags)
    errors = F.filter("_flags", lambda f: f.severity == "error")
    bad = F.flatten(F.transform(errors, lambda f: f.fields))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    )
    kept = F.filter(
        pairs, lambda p: p.value.isNotNull() & ~F.array_contains(F.col("_bad"), p.field)
    )
    return (
        quant.withColumn("_flags", flags)
        .withColumn("_bad", bad)
        .select(*keys, F.inline(kept))
    )


def grouped_stats(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation (0 for one value) and size per group, not rounded."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"), spread(value).alias("std"), F.count(value).alias("n")
    )


def rounded_stats(stats: DataFrame, digits: int = 2) -> DataFrame:
    return stats.withColumn("mean", half_even("mean", digits)).withColumn(
        "std", half_even("std", digits)
    )


def missing_map(quant: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Presence of the headline fields, per record."""
    fields = fields or fixed.STAT_MEASURES
    return quant.select(*keys, *[F.col(f).isNotNull().alias(f"has_{f}") for f in fields])


def defect_gate(flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of errors and warnings; any error fails the gate."""
    keys = keys or []
    return flags.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warn").alias("warnings"),
        (F.count_if(F.col("severity") == "error") == 0).alias("passed"),
    )


def recommended_range(values: DataFrame, keys: list[str], result: str = "result") -> DataFrame:
    """Range of the winners' values, of all values where no winner states one."""
    won = F.col(result).isin(fixed.WINNING_RESULTS)
    low = F.coalesce(F.min(F.when(won, F.col("value"))), F.min("value"))
    high = F.coalesce(F.max(F.when(won, F.col("value"))), F.max("value"))
    return (
        values.groupBy(*keys)
        .agg(low.alias("low"), high.alias("high"))
        .withColumn("single", F.abs(F.col("high") - F.col("low")) < 1e-6)
    )


def value_against_cohorts(values: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Value beside the winner and loser mean. ``stats`` has keys, field, cohort, mean."""
    on = [*keys, "field"]
    means = stats.groupBy(*on).agg(
        F.max(F.when(F.col("cohort") == "win", F.col("mean"))).alias("win_mean"),
        F.max(F.when(F.col("cohort") == "lose", F.col("mean"))).alias("lose_mean"),
    )
    status = (
        F.when(F.col("value") < F.col("win_mean") * 0.85, F.lit("low"))
        .when(F.col("value") >= F.col("win_mean") * 0.95, F.lit("ok"))
        .otherwise(F.lit("info"))
    )
    return values.join(means, on, "left").withColumn("status", status)
