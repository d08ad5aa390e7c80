"""Site facts read from brief text: addresses, zones, parking, certificates, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import half_even
from dossierlake.functions.text import any_of, blank_to_null

# fixed values: how sites, counts and grades are written
SITE_MARKER = r"([^,(]+?)\s*\(\s*부지\s*(\d+)"
ADMIN_PREFIX = r"^((?:\S*[시도군구](?:\s+|$))+)"
PARKING_COUNT = r"(?<![\d,])(\d[\d,]*)\s*대"


def zone_use(text) -> Column:
    """The one standard zone name in a text; NULL when none or several occur."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.filter(F.array(*[F.lit(z) for z in fixed.ZONE_USES]), lambda z: F.contains(c, z))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def zone_use_raw(text) -> Column:
    """The text itself where no single zone name could be read from it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(zone_use(c).isNull(), blank_to_null(c))


def building_uses(facilities: str) -> Column:
    """Legal uses in parentheses, in order and distinct."""
    inner = F.flatten(
        F.transform(F.col(facilities), lambda f: F.regexp_extract_all(f, F.lit(r"\(([^)]*)\)"), F.lit(1)))
    )
    trimmed = F.transform(inner, lambda x: F.trim(x))
    return F.array_distinct(
        F.filter(trimmed, lambda t: (t != "") & (F.endswith(t, F.lit("시설")) | F.contains(t, F.lit("주택"))))
    )


def limits_by_review(conditions: str) -> Column:
    """'심의' when any condition ties a limit to a review, else '법정'."""
    review, limit = any_of(fixed.REVIEW_WORDS), any_of(fixed.LIMIT_WORDS)
    hit = F.exists(F.col(conditions), lambda t: t.rlike(review) & t.rlike(limit))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit("심의")).otherwise(F.lit("법정"))


def limit_authority(conditions: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """'심의' for documents with a condition that ties a limit to a review, one row per condition."""
    review, limit = any_of(fixed.REVIEW_WORDS), any_of(fixed.LIMIT_WORDS)
    hit = F.coalesce(F.max(F.col(text).rlike(review) & F.col(text).rlike(limit)), F.lit(False))
    return conditions.groupBy(*doc).agg(F.when(hit, F.lit("심의")).otherwise(F.lit("법정")).alias("limits_determined_by"))


def certificate_codes(briefs: DataFrame, certs: DataFrame, doc: list[str], sustain: str = "sustain", ordinal: str = "ord") -> DataFrame:
    """Certificate codes of every brief and the least share of renewable energy, which counts only
    where the VARIANT ``sustain`` states a number."""
    field = F.variant_get(F.col(sustain), "$.renewable_energy_min_pct", "variant")
    kind = F.schema_of_variant(field)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(field, "$", "double"))
    known = certifications(certs, doc, ordinal)
    return briefs.select(*doc, number.alias("renewable_pct")).join(known, doc, "left")


def feasibility_projects(briefs: DataFrame, certs: DataFrame, doc: list[str], sustain: str = "sustain") -> DataFrame:
    """The part of a feasibility block that concerns the whole project: certificates, costs (in 100
    million won) and months of construction."""
    figures = ["construction_cost_100m_won", "design_cost_100m_won", "construction_period_months"]
    return certificate_codes(briefs, certs, doc, sustain).join(briefs.select(*doc, *figures), doc)


def certifications(certs: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """Certificate codes from free text; the last statement of each kind holds."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("required_grade", F.lit("")))
    upper = F.upper(text)
    best = F.when(text.contains("최우수"), F.lit("최우수")).when(text.contains("우수"), F.lit("우수"))
    green = F.when(text.contains("녹색건축"), best)
    is_zeb = upper.contains("ZEB") | text.contains("제로에너지") | text.contains("제로 에너지")
    zeb = F.when(is_zeb, F.regexp_extract(text, r"([1-5])\s*등급", 1).try_cast("int"))
    is_bf = upper.contains("BF") | text.rlike("장애물 없는|장애물없는|배리어|무장애")
    barrier_free = F.when(is_bf, best)

    def last(v: Column) -> Column:
        return F.max_by(v, F.when(v.isNotNull(), F.col(ordinal)))

    return certs.groupBy(*doc).agg(
        last(green).alias("green_building"), last(zeb).alias("zeb_grade"), last(barrier_free).alias("bf_grade")
    )


def parking_statements(statements: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """Demand statements with a count, attributed to the last site named before it."""
    t = F.col("text")
    demand = t.rlike(any_of(fixed.PARKING_DEMAND_WORDS)) & ~t.rlike(any_of(fixed.PARKING_OPERATION_WORDS))
    before = F.regexp_extract(t, r"(?s)^(.*?)(?<![\d,])\d[\d,]*\s*대", 1)
    named = F.regexp_extract_all(before, F.lit(r"부지\s*(\d+)"), F.lit(1))
    last = F.get(named, F.size(named) - 1)
    return statements.filter(demand & t.rlike(PARKING_COUNT)).select(
        *doc, ordinal, "text",
        F.replace(F.regexp_extract(t, PARKING_COUNT, 1), F.lit(","), F.lit("")).try_cast("int").alias("count"),
        F.when(last.isNotNull(), F.concat(F.lit("부지"), last)).alias("site_id"),
        t.contains("총").alias("is_total"),
    )


def parking_by_site(statements: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """First demand per site."""
    read = parking_statements(statements, doc, ordinal).filter(F.col("site_id").isNotNull())
    return read.groupBy(*doc, "site_id").agg(
        F.min_by(F.struct("count", "text"), ordinal).alias("_p")
    ).select(*doc, "site_id", F.col("_p.count").alias("required_parking_count"), F.col("_p.text").alias("parking_note"))


def parking_generic(statements: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """First total that names no site."""
    read = parking_statements(statements, doc, ordinal)
    return read.filter(F.col("site_id").isNull() & F.col("is_total")).groupBy(*doc).agg(
        F.min_by("text", ordinal).alias("generic_note")
    )


def site_addresses(addresses: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """'... (부지N)' pieces of an address text; a piece without an administrative prefix
    inherits the latest one of the same text. The first address per site holds.

    Inheritance stays inside one text, so it needs no shuffle.
    """
    text = F.trim("address")
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(SITE_MARKER), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.trim(p), "^,+|,+$", ""))
    )
    numbers = F.regexp_extract_all(text, F.lit(SITE_MARKER), F.lit(2))
    prefixes = F.transform(
        "_pieces", lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, ADMIN_PREFIX, 1), r"\s+", " "))
    )
    inherited = F.transform(
        "_prefixes",
        lambda p, i: F.when(p != "", p).otherwise(
            F.coalesce(
                F.get(
                    F.reverse(F.filter(F.slice(F.col("_prefixes"), F.lit(1), i + 1), lambda q: q != "")),
                    F.lit(0),
                ),
                F.lit(""),
            )
        ),
    )
    split = (
        addresses.filter(text.contains("부지"))
        .withColumn("_pieces", pieces)
        .withColumn("_numbers", numbers)
        .withColumn("_prefixes", prefixes)
        .withColumn("_inherited", inherited)
        .select(
            *doc, ordinal,
            F.posexplode(F.arrays_zip("_pieces", "_numbers", "_prefixes", "_inherited")).alias("pos", "z"),
        )
    )
    full = F.when(F.col("z._prefixes") != "", F.col("z._pieces")).otherwise(
        F.trim(F.concat_ws(" ", F.nullif(F.col("z._inherited"), F.lit("")), F.col("z._pieces")))
    )
    named = split.select(
        *doc, F.concat(F.lit("부지"), F.col("z._numbers")).alias("site_id"), full.alias("address"),
        F.struct(ordinal, "pos").alias("_place"),
    ).filter(F.col("address") != "")
    return named.groupBy(*doc, "site_id").agg(F.min_by("address", "_place").alias("address"))


def feasibility_sites(
    sites: DataFrame, addresses: DataFrame, statements: DataFrame, conditions: DataFrame, doc: list[str]
) -> DataFrame:
    """Normalised sites: address, uses, parking, zone, who sets the limits, key figures.

    ``sites`` has doc, ord, site_id, address, zoning, facilities and the site figures; ``conditions``
    has one row (doc, text) per special condition.
    """
    canonical = sites.withColumn(
        "site_id", F.coalesce(blank_to_null("site_id"), F.concat(F.lit("부지"), F.col("ord").cast("string")))
    )
    parsed = site_addresses(addresses, doc).withColumnRenamed("address", "_parsed")
    figures = [
        "site_area_sqm", "floor_area_ratio_pct", "building_coverage_pct", "max_height_m", "floor_area_sqm",
    ]
    return (
        canonical.join(parsed, [*doc, "site_id"], "left")
        .join(parking_by_site(statements, doc), [*doc, "site_id"], "left")
        .join(parking_generic(statements, doc), doc, "left")
        .join(limit_authority(conditions, doc), doc, "left")
        .select(
            *doc, "site_id",
            F.coalesce(blank_to_null("address"), F.col("_parsed")).alias("address"),
            building_uses("facilities").alias("building_law_uses"),
            "required_parking_count",
            F.coalesce("parking_note", "generic_note").alias("parking_note"),
            zone_use("zoning").alias("zone_use"),
            zone_use_raw("zoning").alias("zone_use_raw"),
            F.coalesce("limits_determined_by", F.lit("법정")).alias("limits_determined_by"),
            *figures,
        )
    )


def diagnosis_requests(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Largest mass the limits allow, for sites that state everything needed."""
    needed = ["site_area_sqm", "building_coverage_pct", "floor_area_ratio_pct", "max_height_m"]
    complete = blank_to_null("address").isNotNull()
    for c in needed:
        complete = complete & F.coalesce(F.col(c) != 0, F.lit(False))
    use = F.coalesce(F.get("building_law_uses", F.lit(0)), F.col("zone_use_raw"), F.lit("미상"))
    return sites.filter(complete).select(
        *keys, "address", use.alias("building_use"), F.col("site_area_sqm").alias("site_area"),
        half_even(F.col("site_area_sqm") * F.col("building_coverage_pct") / 100, 2).alias("building_area"),
        half_even(F.col("site_area_sqm") * F.col("floor_area_ratio_pct") / 100, 2).alias("floor_area_above"),
        F.greatest(F.lit(1), half_even(F.col("max_height_m") / fixed.REQUEST_FLOOR_HEIGHT_M, 0).cast("int")).alias("floors_above"),
        F.col("max_height_m").alias("height"),
        F.col("zone_use").alias("zone_use_override"),
    )


def diagnosis_digest(diagnoses: DataFrame, keys: list[str], payload: str = "diagnosis") -> DataFrame:
    """Envelope limits, height rules, required reviews, confidence and references of a
    stored diagnosis (VARIANT column)."""
    v = F.col(payload)

    def field(category: str, name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.results['{category}'].{name}", kind)

    reviews = F.coalesce(
        F.try_variant_get(v, "$.applicable_reviews.items", "array<variant>"), F.array().cast("array<variant>")
    )
    required = F.filter(
        reviews, lambda r: F.coalesce(F.try_variant_get(r, "$.severity", "string") == "REQUIRED", F.lit(False))
    )
    results = F.coalesce(
        F.map_values(F.try_variant_get(v, "$.results", "map<string,variant>")), F.array().cast("array<variant>")
    )
    doubtful = F.exists(
        results,
        lambda r: F.coalesce(
            F.try_variant_get(r, "$.source", "string").rlike(any_of(fixed.LOW_CONFIDENCE_TOKENS)), F.lit(False)
        ),
    )
    unresolved = field("건폐율", "pass", "boolean").isNull() | field("용적률", "pass", "boolean").isNull()
    refs = F.concat(
        *[
            F.coalesce(
                F.try_variant_get(v, f"$.results['{c}'].law_refs", "array<variant>"),
                F.array().cast("array<variant>"),
            )
            for c in ("높이_일조", "건폐율", "용적률")
        ]
    )
    names = F.array_distinct(
        F.filter(
            F.transform(refs, lambda r: F.try_variant_get(r, "$.name", "string")),
            lambda n: F.coalesce(n != "", F.lit(False)),
        )
    )
    heights = [
        ("north_setback_m", "double"), ("shadow_applies", "boolean"), ("shadow_setback_rule", "string"),
        ("shadow_min_setback_m", "double"), ("road_height_limit_m", "double"), ("parcel_north_depth_m", "double"),
    ]
    return diagnoses.select(
        *keys,
        F.try_variant_get(v, "$.signal", "string").alias("signal"),
        F.try_variant_get(v, "$.overall_score", "double").alias("overall_score"),
        field("건폐율", "limit_pct", "double").alias("bcr_limit_pct"),
        field("용적률", "limit_pct", "double").alias("far_limit_pct"),
        *[field("높이_일조", n, k).alias(n) for n, k in heights],
        F.transform(required, lambda r: F.try_variant_get(r, "$.name", "string")).alias("reviews_required"),
        (doubtful | unresolved).alias("low_confidence"),
        names.alias("law_refs"),
    )


def law_reference_names(digests: DataFrame, doc: list[str], ordinal: str) -> DataFrame:
    """Reference names across the sites of a document, distinct, with their first place."""
    named = digests.select(*doc, ordinal, F.posexplode("law_refs").alias("pos", "name"))
    return named.filter(F.trim("name") != "").groupBy(*doc, F.trim("name").alias("name")).agg(
        F.min(F.struct(ordinal, "pos")).alias("first_seen")
    )
