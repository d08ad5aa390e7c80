"""Resolution of several statements of one fact: first wins, unions, keyed merges.

Order is always an explicit ordinal, and "first" is always a ``min_by`` aggregate, which is
combined before the shuffle and therefore indifferent to hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions import nested
from dossierlake.functions.text import blank_to_null, path_segments

AREA_TABLE, SITE_PLAN, PROGRAMME, REGULATIONS, PROGRAMME_SITE = range(5)


def first_value(value, order: Column) -> Column:
    """Aggregate: the value of the earliest row that has one."""
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.when(v.isNotNull(), order))


def stated_measures(pages: DataFrame, doc: list[str], source: int, ordinal: str) -> DataFrame:
    """Long (doc, field, value, source_rank, ordinal, step) of one kind of source page.

    Area tables and site plans use the measure names; programme and regulation pages use
    their own names, two of which may state the same measure (``step`` keeps their order).
    """
    if source in (AREA_TABLE, SITE_PLAN):
        names = {m: m for m in fixed.MEASURES}
    elif source == PROGRAMME_SITE:
        names = {
            k: fixed.PROGRAM_FIELD_MAP[k]
            for k in ("site_area_sqm", "building_coverage_limit_pct", "floor_area_ratio_limit_pct")
        }
    else:
        names = fixed.PROGRAM_FIELD_MAP
    pairs = [
        F.struct(
            F.lit(target).alias("field"),
            F.col(name).cast("double").alias("value"),
            F.lit(step).alias("step"),
        )
        for step, (name, target) in enumerate(names.items())
        if name in pages.columns
    ]
    return (
        pages.select(*doc, F.col(ordinal).alias("ordinal"), F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .withColumn("source_rank", F.lit(source))
    )


def resolve_measures(stated: DataFrame, doc: list[str]) -> DataFrame:
    """First stated value per field over (source rank, ordinal, step)."""
    order = F.struct("source_rank", "ordinal", "step") if "step" in stated.columns else F.struct(
        "source_rank", "ordinal"
    )
    picked = stated.groupBy(*doc, "field").agg(
        F.min_by(F.struct("value", "source_rank"), order).alias("_p")
    )
    return picked.select(*doc, "field", "_p.value", "_p.source_rank")


def headline(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered fallback in which 0 and empty values are skipped.

    ``candidates`` has keys, metric, value, source_rank.
    """
    usable = candidates.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    return usable.groupBy(*keys, "metric").agg(
        F.min_by("value", "source_rank").alias("value"), F.min("source_rank").alias("source_rank")
    )


def per_site_percentages(sites: DataFrame, doc: list[str], field: str, ordinal: str) -> DataFrame:
    """One site: its value. Several: the values listed as 'site: v%' in site order."""
    stated = sites.filter(F.col(field).isNotNull()).withColumn(
        "_label",
        F.concat(
            F.coalesce(blank_to_null("site_id"), F.concat(F.lit("부지"), F.col(ordinal))),
            F.lit(": "), F.col(field).cast("string"), F.lit("%"),
        ),
    )
    return stated.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("sites"),
        F.min_by(F.col(field).cast("string"), F.col(ordinal)).alias("first_value"),
        F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("_label").alias("l")))).alias("_l"),
    ).select(
        *doc,
        F.when(F.col("sites") == 1, F.col("first_value"))
        .otherwise(F.array_join(F.transform("_l", lambda x: x.l), " / "))
        .alias("stated"),
    )


def first_wins(rows: DataFrame, keys: list[str], ordinal: str, fields: list[str]) -> DataFrame:
    """Field-wise first non-null over the rows of a key."""
    return rows.groupBy(*keys).agg(*[first_value(f, F.col(ordinal)).alias(f) for f in fields])


def first_wins_long(rows: DataFrame, keys: list[str], ordinal: str, value: str = "value") -> DataFrame:
    """First non-empty value per key (empty text, objects and lists do not count)."""
    filled = rows.filter(
        F.col(value).isNotNull() & ~F.trim(F.col(value).cast("string")).isin("", "{}", "[]")
    )
    return filled.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col(ordinal).alias("o")), F.col(ordinal)).alias("_p")
    ).select(*keys, F.col("_p.v").alias(value), F.col("_p.o").alias("source"))


def ordered_union(items: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """Distinct items of a key with the place of their first occurrence."""
    return items.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.min(ordinal).alias("first_seen")
    )


def row_supplement(primary: DataFrame, extra: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Primary rows first; extra rows only for keys not seen yet; first row per key."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(extra.withColumn("_rank", F.lit(1)))
    rest = [c for c in primary.columns if c not in keys]
    picked = both.groupBy(*keys).agg(
        F.min_by(F.struct(*rest, F.col("_rank").alias("source_rank")), F.struct("_rank", ordinal)).alias("_p")
    )
    return picked.select(*keys, "_p.*")


def keyed_merge(
    old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], forced: list[str]
) -> DataFrame:
    """Old and new records by key: new non-empty fields win, nothing is deleted.

    ``forced`` fields take the new value even when it is empty, provided the new record
    carries the field at all (NULL means it does not).
    """
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields + forced],
                   F.lit(True).alias("_in_new"))
    joined = old.join(n, keys, "full_outer")
    merged = [
        F.coalesce(F.nullif(F.col(f"_n_{c}"), F.lit("")), F.col(c)).alias(c) for c in fields
    ] + [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in forced]
    return joined.select(*keys, *merged)


def site_key(c: str = "site_id") -> Column:
    """Site name without a trailing '(...)'; unnamed sites share one name."""
    named = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("단일부지"))
    return F.trim(F.regexp_replace(F.trim(named), r"\s*\([^)]*\)\s*$", ""))


def merge_sites(
    sites: DataFrame, doc: list[str], ordinal: str, fields: list[str], facilities: str | None = None
) -> DataFrame:
    """Sites of several pages by normalised name, field-wise first non-null.

    Unnumbered sites are dropped where two or more numbered ones exist; empty sites are
    dropped where two or more remain and at least one is not empty.
    """
    keyed = sites.withColumn("site_id", site_key())
    aggs = [first_value(f, F.col(ordinal)).alias(f) for f in fields]
    if facilities:
        aggs.append(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sort_array(
                            F.collect_list(
                                F.struct(F.col(ordinal).alias("o"), F.col(facilities).alias("f"))
                            )
                        ),
                        lambda x: F.coalesce(x.f, F.array().cast("array<string>")),
                    )
                )
            ).alias(facilities)
        )
    merged = keyed.groupBy(*doc, "site_id").agg(F.min(ordinal).alias("first_seen"), *aggs)
    numbered = F.col("site_id").rlike(r"^부지\d+")
    values = [
        F.coalesce(~F.col(f).cast("string").isin("", "0", "0.0"), F.lit(False)) for f in fields
    ]
    filled = values[0]
    for v in values[1:]:
        filled = filled | v
    if facilities:
        filled = filled | (F.size(facilities) > 0)
    merged = merged.withColumn("_num", numbered).withColumn("_filled", filled)
    per_doc = merged.groupBy(*doc).agg(
        F.count_if("_num").alias("_nums"),
        F.count(F.lit(1)).alias("_all"),
        F.count_if("_filled").alias("_full"),
        F.count_if(F.col("_num") & F.col("_filled")).alias("_full_nums"),
    )
    joined = merged.join(per_doc, doc)
    only_numbered = F.col("_nums") >= 2
    remaining = F.when(only_numbered, F.col("_nums")).otherwise(F.col("_all"))
    full = F.when(only_numbered, F.col("_full_nums")).otherwise(F.col("_full"))
    keep = (~only_numbered | F.col("_num")) & (
        (remaining < 2) | (full == 0) | F.col("_filled")
    )
    return joined.filter(keep).drop("_num", "_filled", "_nums", "_all", "_full", "_full_nums")


def normalise_guidelines(items: DataFrame, doc: list[str]) -> DataFrame:
    """Guideline items as a two-level tree in long form.

    ``items`` has doc, page, entry, item, facility_scope, space_scope, category,
    section_path, label, text. Entries equal in scope, space, path and
    first item are kept once; scopes are trimmed; items equal in label and text are kept
    once per (scope, section, sub_path).
    """
    entry_keys = [*doc, "page", "entry"]
    place = F.struct("page", "entry")
    heads = items.groupBy(*entry_keys).agg(
        F.min_by(
            F.struct(
                F.trim(F.coalesce("facility_scope", F.lit(""))).alias("scope"),
                F.trim(F.coalesce("space_scope", F.lit(""))).alias("space"),
                F.trim(F.coalesce("section_path", F.lit(""))).alias("path"),
                F.coalesce("text", F.lit("")).alias("head"),
            ),
            F.col("item"),
        ).alias("k")
    )
    kept = heads.groupBy(*doc, "k").agg(F.min(place).alias("_first")).select(
        *doc, F.col("_first.page").alias("page"), F.col("_first.entry").alias("entry")
    )
    segments = path_segments("section_path")
    flat = (
        items.filter(blank_to_null("text").isNotNull())
        .join(kept, entry_keys, "left_semi")
        .select(
            *doc,
            F.coalesce(F.nullif(F.trim("facility_scope"), F.lit("")), F.lit("전체")).alias("facility_scope"),
            F.coalesce(F.nullif(F.trim("space_scope"), F.lit("")), F.lit("전체")).alias("space_scope"),
            F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("기타")).alias("category"),
            F.coalesce(F.get(segments, F.lit(0)), F.lit("")).alias("section"),
            F.array_join(F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(0))), " > ").alias("sub_path"),
            F.trim(F.coalesce("label", F.lit(""))).alias("label"),
            F.trim("text").alias("text"),
            F.struct("page", "entry", "item").alias("place"),
        )
    )
    group = [*doc, "facility_scope", "section"]
    meta = flat.groupBy(*group).agg(
        F.min_by("space_scope", "place").alias("space_scope"),
        F.min_by("category", "place").alias("category"),
    )
    unique = flat.groupBy(*group, "sub_path", "label", "text").agg(F.min("place").alias("place"))
    return unique.join(meta, group)


def variant_items(v) -> Column:
    """VARIANT that may be an object or a list -> ARRAY<VARIANT>, for explode."""
    c = F.col(v) if isinstance(v, str) else v
    kind = F.schema_of_variant(c)
    return (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))
        .when(kind.startswith("OBJECT"), F.array(c))
        .otherwise(F.array().cast("array<variant>"))
    )


def distinct_records(rows: DataFrame, keys: list[str], json: str, ordinal: str = "ord") -> DataFrame:
    """Records of a key in order of their first appearance, each once: records are equal whose JSON
    is, however its keys are ordered. Columns: keys, the record's first ordinal, text and copies."""
    same = rows.withColumn("_same", F.coalesce(nested.canonical(json), F.col(json)))
    first = F.min_by(F.struct(F.col(ordinal), F.col(json)), ordinal)
    return same.groupBy(*keys, "_same").agg(first.alias("_r"), F.count(F.lit(1)).alias("copies")).select(*keys, "_r.*", "copies")
