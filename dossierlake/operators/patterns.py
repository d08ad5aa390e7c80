"""Outcome-cohort patterns per facility type, all facilities in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import half_even
from dossierlake.operators import measures

GROUP = ["facility_type", "cohort"]


def cohort(result: str = "result") -> Column:
    """win for won or contracted records, lose for lost ones, NULL otherwise."""
    return F.when(F.col(result).isin(fixed.WINNING_RESULTS), F.lit("win")).when(
        F.col(result) == "lose", F.lit("lose")
    )


def with_cohort(subs: DataFrame) -> DataFrame:
    return subs.withColumn("cohort", cohort()).filter(F.col("cohort").isNotNull())


def cohort_sizes(subs: DataFrame) -> DataFrame:
    return with_cohort(subs).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))


def page_distribution(cls: DataFrame, keys: list[str], kind: str = "primary_type") -> DataFrame:
    """Pages per document and type."""
    return cls.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("pages"))


def page_share(counts: DataFrame, total: str = "total_pages") -> DataFrame:
    """Share of pages in the three forms in use: rounded, truncated and one decimal."""
    share = F.lit(100.0) * F.col("pages") / F.greatest(F.col(total), F.lit(1))
    return (
        counts.withColumn("pct_rounded", F.floor(share + 0.5).cast("int"))
        .withColumn("pct_truncated", F.floor(share).cast("int"))
        .withColumn("pct_decimal", half_even(share, 1))
    )


def page_stats(counts: DataFrame, keys: list[str], digits: int | None = 3) -> DataFrame:
    """Statistics of page counts and page ratios over the documents that have the type.

    ``counts`` has keys, primary_type, pages, total_pages.
    """
    return measures.grouped_stats(_page_values(counts, keys, digits), [*keys, "key"])


def _page_values(counts: DataFrame, keys: list[str], digits: int | None = 3) -> DataFrame:
    """Pages and page ratio of every document and type as (keys, key, value)."""
    ratio = F.col("pages") / F.coalesce(
        F.nullif(F.col("total_pages").cast("double"), F.lit(0.0)), F.lit(1.0)
    )
    if digits is not None:
        ratio = half_even(ratio, digits)
    pairs = F.array(
        F.struct(F.col("primary_type").alias("key"), F.col("pages").cast("double").alias("value")),
        F.struct(F.concat("primary_type", F.lit("_ratio")).alias("key"), ratio.alias("value")),
    )
    return counts.select(*keys, F.inline(pairs))


def first_concept(concepts: DataFrame, keys: list[str], ordinal: str = "ord") -> DataFrame:
    """A list-valued concept contributes its first element only."""
    rest = [c for c in concepts.columns if c not in [*keys, ordinal]]
    return (
        concepts.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_c"))
        .select(*keys, "_c.*")
    )


def term_frequency(
    terms: DataFrame, sizes: DataFrame, keys: list[str], term: str, top: int | None = None
) -> DataFrame:
    """Occurrences of a term over the number of records in its cohort.

    Counting is pre-aggregated before the shuffle; ``sizes`` has one row per cohort.
    """
    counted = terms.filter(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(*keys, term).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    if top:
        rank = Window.partitionBy(*keys).orderBy(F.desc("occurrences"), F.asc(term))
        counted = counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    return counted.join(sizes, keys).withColumn("freq", F.col("occurrences") / F.col("size"))


def facility_pattern(
    subs: DataFrame,
    page_counts: DataFrame,
    quant: DataFrame,
    keywords: DataFrame,
    mass_types: DataFrame,
    top: int | None = None,
) -> DataFrame:
    """Long pattern table for every facility that has winners.

    All inputs carry facility_type and cohort. Losers add statistics only where winners
    exist, and no mass types; all keywords, or the ``top`` most frequent. Values are not rounded; use ``rounded_pattern`` for display.
    """
    none = F.lit(None).cast("double")

    def family(df: DataFrame, name: str, key: Column, value: Column = none) -> DataFrame:
        return df.select(*GROUP, F.lit(name).alias("family"), key.alias("key"), value.alias("value"))

    long = family(subs, "count", F.lit("records"))
    for part in (
        family(_page_values(page_counts, GROUP), "page_distribution", F.col("key"), F.col("value")),
        family(measures.clean_values(quant, GROUP), "quantitative", F.col("field"), F.col("value")),
        family(keywords.filter(F.col("keyword") != ""), "concept_keywords", F.col("keyword")),
        family(
            mass_types.filter((F.col("cohort") == "win") & (F.col("mass_type") != "")), "mass_types", F.col("mass_type")
        ),
    ):
        long = long.unionByName(part)
    # one aggregation for all families; sizes are then read off its own rows
    found = long.groupBy(*GROUP, "family", "key").agg(
        F.avg("value").alias("mean"), measures.spread("value").alias("_std"),
        F.count("value").alias("_values"), F.count(F.lit(1)).alias("_rows"),
    )
    records = F.col("family") == "count"
    of_facility = Window.partitionBy("facility_type")
    for c in ("win", "lose"):
        found = found.withColumn(f"_{c}", F.max(F.when(records & (F.col("cohort") == c), F.col("_rows"))).over(of_facility))
    found = found.filter(F.col("_win").isNotNull())
    stat = F.col("family").isin("page_distribution", "quantitative")
    size = F.when(F.col("cohort") == "win", F.col("_win")).otherwise(F.col("_lose"))
    out = found.select(
        *GROUP, "family", "key", "mean", F.when(stat, F.col("_std")).alias("std"),
        F.when(stat, F.col("_values")).otherwise(F.col("_rows")).alias("n"),
        F.when(~stat & ~records, F.col("_rows") / size).alias("freq"),
    )
    if top is None:
        return out
    ranks = Window.partitionBy(*GROUP, "family").orderBy(F.desc("n"), F.asc("key"))
    ranked = out.withColumn("_rank", F.row_number().over(ranks))
    return ranked.filter((F.col("family") != "concept_keywords") | (F.col("_rank") <= top)).drop("_rank")


def rounded_pattern(pattern: DataFrame) -> DataFrame:
    return (
        pattern.withColumn("mean", half_even("mean", 2))
        .withColumn("std", half_even("std", 2))
        .withColumn("freq", half_even("freq", 2))
    )


def selected_pattern(subs: DataFrame, chosen: DataFrame, keys: list[str], build) -> DataFrame:
    """The same statistics over an ad-hoc selection: semi join, then any builder above."""
    return build(subs.join(chosen.select(*keys).distinct(), keys, "left_semi"))


def cohort_table(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Winner and loser mean side by side, with the scale a bar chart would use."""
    on = [*keys, "key"]
    win = stats.filter(F.col("cohort") == "win").select(*on, F.col("mean").alias("win_mean"))
    lose = stats.filter(F.col("cohort") == "lose").select(*on, F.col("mean").alias("lose_mean"))
    both = win.join(lose, on, "full_outer")
    scale = both.groupBy(*keys).agg(
        F.greatest(
            F.max(F.coalesce("win_mean", F.lit(0.0))),
            F.max(F.coalesce("lose_mean", F.lit(0.0))),
            F.lit(0.1),
        ).alias("scale")
    )
    return both.join(scale, keys)


def keyword_lift(freqs: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Winner keywords (all, or the ``top`` most frequent) with the difference to the losers' frequency."""
    win = freqs.filter(F.col("cohort") == "win")
    if top is not None:
        order = Window.partitionBy(*keys).orderBy(F.desc("freq"), F.asc("keyword"))
        win = win.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    win = win.select(*keys, "keyword", F.col("freq").alias("win_freq"))
    lose = freqs.filter(F.col("cohort") == "lose").select(
        *keys, "keyword", F.col("freq").alias("lose_freq")
    )
    diff = F.col("win_freq") - F.col("lose_freq")
    return (
        win.join(lose, [*keys, "keyword"], "left")
        .withColumn("lose_freq", F.coalesce("lose_freq", F.lit(0.0)))
        .withColumn(
            "lift",
            F.when(diff > 0.2, F.lit("positive"))
            .when(diff < -0.2, F.lit("negative"))
            .otherwise(F.lit("neutral")),
        )
    )


def collect_insights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Insight lines of competitions that state any strength or weakness.

    ``lines`` has keys, kind, pos, text. The result stays long: one row per line.
    """
    told = lines.filter(F.col("kind").isin("winner_strengths", "loser_weaknesses"))
    return lines.join(told.select(*keys).distinct(), keys, "left_semi")


def frequent_lines(lines: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Insight lines ranked by frequency per group and kind, all or the first ``top``."""
    counted = lines.groupBy(*keys, "kind", "text").agg(F.count(F.lit(1)).alias("occurrences"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("occurrences"), F.asc("text"))
    ranked = counted.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def sample_basis(subs: DataFrame, cases: DataFrame, comparisons: DataFrame) -> DataFrame:
    """How much evidence a facility offers, and whether to proceed on it."""
    base = with_cohort(subs).groupBy("facility_type").agg(
        F.count_if(F.col("cohort") == "win").alias("win_n"),
        F.count_if(F.col("cohort") == "lose").alias("lose_n"),
    )
    case = cases.groupBy("facility_type").agg(F.count(F.lit(1)).alias("case_count"))
    comp = comparisons.groupBy("facility_type").agg(F.count(F.lit(1)).alias("comparison_count"))
    out = base.join(case, "facility_type", "full_outer").join(comp, "facility_type", "full_outer")
    names = ["win_n", "lose_n", "case_count", "comparison_count"]
    out = out.select("facility_type", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("proceed", sum((F.col(n) for n in names[1:]), F.col(names[0])) > 0)


def project_rollup(subs: DataFrame) -> DataFrame:
    """Submissions and winners per project."""
    return subs.groupBy("facility_type", "competition_id").agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_if(F.col("result").isin(fixed.WINNING_RESULTS)).alias("winners"),
    )


def facility_rollup(projects: DataFrame) -> DataFrame:
    return projects.groupBy("facility_type").agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum("submissions").alias("submissions"),
        F.sum("winners").alias("winners"),
    )
