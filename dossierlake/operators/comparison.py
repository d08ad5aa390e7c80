"""Comparison of submissions: blind labels, alignment with outcomes, matrices, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.labels import anonymous_label, floor_label, floor_order, programme_category
from dossierlake.operators import graph, scan


def blind_labels(subs: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Label every submission of a competition in order and drop its result."""
    numbered = scan.positions(subs, keys, ordinal, ordinal, name="label_no")
    return numbered.withColumn("label", anonymous_label("label_no")).drop("result")


def restore_names(cells: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Replace labels by names; a label without entry stays as it is."""
    names = labels.select(*keys, "label", F.col("company").alias("_name"))
    return cells.join(names, [*keys, "label"], "left").withColumn(
        "company", F.coalesce(F.col("_name"), F.col("label"))
    ).drop("_name")


def gap_analysis(ranking: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """How well a blind ranking agrees with the outcome.

    ``ranking`` has keys, company, pos; ``results`` has keys, company, result. Sizes are
    counted first, so no competition has to sit in one task.
    """
    size = ranking.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ranked"), F.min_by("company", "pos").alias("blind_top1")
    )
    won = results.filter(F.col("result").isin(fixed.WINNING_RESULTS)).select(*keys, "company").distinct()
    placed = won.join(ranking.select(*keys, "company", "pos"), [*keys, "company"], "left").join(
        size, keys, "left"
    )
    half = F.greatest(F.lit(1), F.floor((F.col("ranked") + 1) / 2))
    per = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("winners"),
        F.count_if(F.col("pos") <= half).alias("winners_in_top"),
        F.coalesce(F.max(F.col("company") == F.col("blind_top1")), F.lit(False)).alias("_match"),
    )
    every = results.select(*keys).unionByName(ranking.select(*keys)).distinct()
    joined = every.join(size, keys, "left").join(per, keys, "left")
    ranked, winners = F.coalesce("ranked", F.lit(0)), F.coalesce("winners", F.lit(0))
    match = F.coalesce("_match", F.lit(False))
    share = F.col("winners_in_top") / F.nullif(winners.cast("double"), F.lit(0.0))
    return joined.select(
        *keys,
        "blind_top1",
        ranked.alias("ranked"),
        winners.alias("winners"),
        match.alias("top1_matches_winner"),
        F.when((ranked == 0) | (winners == 0), F.lit("unknown"))
        .when(match & (share >= 0.9), F.lit("high"))
        .when(share >= 0.5, F.lit("partial"))
        .otherwise(F.lit("low"))
        .alias("alignment"),
    )


def floor_programmes(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct programmes per floor and company, in order of first mention.

    ``plans`` has keys, company, ord, floor_level, programme. Unreadable floors are dropped.
    """
    read = plans.withColumn("floor_order", floor_order("floor_level")).filter(
        F.col("floor_order").isNotNull() & (F.trim("programme") != "")
    )
    return read.groupBy(*keys, "company", "floor_order", F.trim("programme").alias("programme")).agg(
        F.min("ord").alias("first_seen")
    )


def floor_cells(plans: DataFrame, keys: list[str]) -> DataFrame:
    """One cell per floor and company: programmes and the category of the first one."""
    programmes = floor_programmes(plans, keys)
    return programmes.groupBy(*keys, "company", "floor_order").agg(
        F.count(F.lit(1)).alias("programmes"),
        programme_category(F.min_by("programme", "first_seen")).alias("category"),
        F.min_by("programme", "first_seen").alias("first_programme"),
    ).withColumn("floor", floor_label("floor_order"))


#: Columns that a matrix may have at most.
MOST_COLUMNS = 200


def found_values(df: DataFrame, column: str, most: int = MOST_COLUMNS) -> list:
    """The values of a column, in order, that a pivot makes columns of; more than ``most`` are an error,
    so what reaches the driver is bounded."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values; restrict the rows first")
    return values


def floor_matrix(cells: DataFrame, keys: list[str], companies: list | None = None) -> DataFrame:
    """Floors as rows, companies as columns, the category of the first programme in each cell; the
    companies are those that occur, in order, unless they are given; then the cells are written once, not
    made a second time to look for them."""
    if companies is None:
        cells = graph.stored(cells.select(*keys, "floor_order", "floor", "company", "category"))
    return cells.groupBy(*keys, "floor_order", "floor").pivot("company", companies if companies is not None else found_values(cells, "company")).agg(
        F.first("category")
    )


def card_filter(cards: DataFrame, facility: str | None = None, result: str | None = None) -> DataFrame:
    """Cards of a facility; result 'win' keeps cards with actual winners, 'lose' the others."""
    out = cards
    if facility:
        out = out.filter(F.col("facility_type") == facility)
    won = F.coalesce(F.col("winners"), F.lit(0)) > 0
    if result == "win":
        out = out.filter(won)
    elif result == "lose":
        out = out.filter(~won)
    return out


def cross_selection(
    chosen: DataFrame, subs: DataFrame, projects: DataFrame, briefs: DataFrame, request: list[str]
) -> DataFrame:
    """Chosen submissions of several competitions, ready to be compared.

    ``chosen`` has request, facility_type, competition_id, company. A company chosen in more
    than one competition carries the project name. Each row takes its own brief digest when
    the request spans competitions; otherwise ``shared_brief`` says that one brief serves all.
    Requests with fewer than two existing submissions are dropped.
    """
    place = ["facility_type", "competition_id"]
    spread = chosen.groupBy(*request, "company").agg(
        F.count_distinct("competition_id").alias("_company_in")
    )
    width = chosen.groupBy(*request).agg(F.count_distinct(F.struct(*place)).alias("_competitions"))
    found = chosen.join(subs, [*place, "company"])
    size = found.groupBy(*request).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    joined = (
        found.join(size, request)
        .join(spread, [*request, "company"])
        .join(width, request)
        .join(projects.select(*place, "competition_name"), place, "left")
        .join(briefs.select(*place, "brief_digest"), place, "left")
    )
    name = F.coalesce("competition_name", F.col("competition_id").cast("string"))
    several = F.col("_competitions") > 1
    return joined.select(
        *request, *place, "company",
        F.when(F.col("_company_in") > 1, F.concat(F.col("company").cast("string"), F.lit(" ("), name, F.lit(")")))
        .otherwise(F.col("company").cast("string")).alias("label"),
        (~several).alias("shared_brief"),
        F.when(several, F.col("brief_digest")).alias("brief_digest"),
    )


def reference_cases(winners: DataFrame, projects: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Winning records with a strategy text, per facility, newest first; all or the first ``limit``.

    A rank limit is applied before the shuffle as well, so a large facility stays split.
    """
    told = winners.filter(F.trim(F.coalesce("main_strategy", F.lit(""))) != "")
    dated = told.join(
        projects.select("facility_type", "competition_id", "competition_name", "created_at"),
        ["facility_type", "competition_id"], "left",
    ).withColumn("_when", F.coalesce(F.col("created_at").cast("string"), F.lit("")))
    order = Window.partitionBy("facility_type").orderBy(F.desc("_when"), *keys)
    return (
        dated.withColumn("rank", F.row_number().over(order))
        .filter(F.lit(True) if limit is None else F.col("rank") <= limit)
        .withColumn(
            "competition_name", F.coalesce("competition_name", F.col("competition_id").cast("string"))
        )
        .drop("_when")
    )


def pattern_summary(sizes: DataFrame, keywords: DataFrame, lines: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Signals of a facility's pattern, for facilities with winners: facility_type, win_n, lose_n,
    section, rank, text; all or the first ``limits[section]`` of each.

    ``sizes`` has facility_type, cohort, size; ``keywords`` facility_type, cohort, rank, keyword;
    ``lines`` facility_type, kind, rank, text. Sections are winner_keywords, loser_keywords and the kinds.
    """
    n = lambda c: F.coalesce(F.sum(F.when(F.col("cohort") == c, F.col("size"))), F.lit(0))
    won = sizes.groupBy("facility_type").agg(n("win").alias("win_n"), n("lose").alias("lose_n")).where("win_n > 0")
    section = F.when(F.col("cohort") == "win", F.lit("winner_keywords")).otherwise(F.lit("loser_keywords"))
    signals = keywords.select("facility_type", section.alias("section"), "rank", F.col("keyword").alias("text")).unionByName(
        lines.select("facility_type", F.col("kind").alias("section"), "rank", "text")
    )
    for name, most in (limits or {}).items():
        signals = signals.where((F.col("section") != name) | (F.col("rank") <= most))
    return won.join(signals, "facility_type").select("facility_type", "win_n", "lose_n", "section", "rank", "text")


def comparison_excerpts(texts: DataFrame, projects: DataFrame, limit: int | None = None, min_len: int = 10) -> DataFrame:
    """Concept texts per facility, newest projects first; all or the first ``limit``. ``texts`` has axis_ord and text."""
    long_enough = texts.filter(F.length(F.trim("text")) >= min_len)
    dated = long_enough.join(
        projects.select("facility_type", "competition_id", "created_at"),
        ["facility_type", "competition_id"],
    ).withColumn("_when", F.coalesce(F.col("created_at").cast("string"), F.lit("")))
    order = Window.partitionBy("facility_type").orderBy(F.desc("_when"), "competition_id", "axis_ord")
    ranked = dated.withColumn("rank", F.row_number().over(order)).drop("_when")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def axis_rubric(base: DataFrame, override: DataFrame, facilities: DataFrame) -> DataFrame:
    """Rubric per facility and axis: group base plus the facility's own signals and hint.

    ``base`` has group, axis, signals; ``override`` has facility_type, axis, signals_extra,
    rubric_hint; ``facilities`` has facility_type, group.
    """
    nothing = F.array().cast("array<string>")
    return (
        facilities.join(base, "group")
        .join(override, ["facility_type", "axis"], "left")
        .withColumn("signals", F.concat("signals", F.coalesce("signals_extra", nothing)))
        .withColumn("rubric_hint", F.coalesce("rubric_hint", F.lit("")))
        .drop("signals_extra")
    )


def lock_alternatives(base: DataFrame, alternatives: DataFrame, doc: list[str], keep: int | None = None) -> DataFrame:
    """Required zones of the base plan hold in every alternative.

    ``base`` has doc, ord, program, plan, level, required; ``alternatives`` has doc, alt,
    ord, program, plan, level, required. Alternatives with a named zone are kept, all or
    the first ``keep``; required zones overwrite plan and level and are added where missing.
    """
    name = F.trim("program")
    fixed_zones = base.filter(F.col("required") & (name != "")).groupBy(*doc, name.alias("program")).agg(
        F.min_by(F.struct("plan", "level"), "ord").alias("c")
    ).select(*doc, "program", F.col("c.plan").alias("c_plan"), F.col("c.level").alias("c_level"))
    zones = alternatives.withColumn("program", name).filter(F.col("program") != "")
    order = Window.partitionBy(*doc).orderBy("alt")
    kept = zones.select(*doc, "alt").distinct().withColumn("_r", F.row_number().over(order)).filter(
        F.lit(True) if keep is None else F.col("_r") <= keep
    ).drop("_r")
    zones = zones.join(kept, [*doc, "alt"], "left_semi")
    locked = zones.join(fixed_zones.withColumn("_lock", F.lit(True)), [*doc, "program"], "left").select(
        *doc, "alt", "program",
        F.when(F.col("_lock"), F.col("c_plan")).otherwise(F.col("plan")).alias("plan"),
        F.when(F.col("_lock"), F.col("c_level")).otherwise(F.col("level")).alias("level"),
        (F.coalesce("_lock", F.lit(False)) | F.coalesce("required", F.lit(False))).alias("required"),
        F.lit(False).alias("added"),
    )
    missing = kept.join(fixed_zones, doc).join(
        zones.select(*doc, "alt", "program").distinct(), [*doc, "alt", "program"], "left_anti"
    ).select(
        *doc, "alt", "program", F.col("c_plan").alias("plan"), F.col("c_level").alias("level"),
        F.lit(True).alias("required"), F.lit(True).alias("added"),
    )
    return locked.unionByName(missing)


