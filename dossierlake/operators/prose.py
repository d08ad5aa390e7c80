"""Checks of written text against its sources: citations, numbers, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions import text as T

# fixed values: patterns of citations and of numbers with and without a risky unit
CITATION = r"(?i)\(p\.\s*([0-9][0-9,\s]*|\?)\s*\)"
_UNIT = "|".join(fixed.RISKY_UNITS)
PAIR = r"(\d[\d,]*(?:\.\d+)?)\s*(" + _UNIT + ")"
# a whole number that no risky unit follows
BARE = (
    r"(\d[\d,]*+(?:\.\d++)?+)"
    r"(?!\s{0,3}(?:만원|세대|가구)|\s{0,4}(?:억|원|%|호))"
)


def page_bounds(documents: DataFrame, pages: DataFrame, doc: list[str]) -> DataFrame:
    """Valid page limit: total_pages if positive, else the largest page seen, else NULL."""
    seen = pages.groupBy(*doc).agg(F.max("page").alias("_seen"))
    stated = F.when(F.col("total_pages") > 0, F.col("total_pages").cast("int"))
    return documents.join(seen, doc, "left").select(
        *doc, F.coalesce(stated, F.col("_seen").cast("int")).alias("bound")
    )


def citations(prose: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per cited page with the citation as written; '(p.?)' cites nothing."""
    written = F.regexp_extract_all(F.col(text), F.lit(CITATION), F.lit(0))
    cited = prose.select(*keys, F.explode(written).alias("citation")).filter(~F.col("citation").contains("?"))
    inside = F.regexp_extract("citation", CITATION, 1)
    number = F.regexp_replace("_n", r"\s", "")
    return (
        cited.withColumn("_n", F.explode(F.split(inside, ",")))
        .withColumn("cited_page", number.try_cast("long"))
        .filter(F.col("cited_page").isNotNull())
        .drop("_n")
    )


def citation_flags(
    prose: DataFrame, bounds: DataFrame, keys: list[str], union_keys: list[str] | None = None,
    place: list[str] | None = None,
) -> DataFrame:
    """Citations outside 1..bound.

    A writer without an entry in ``bounds`` is checked against the widest bound of
    ``union_keys``; where no bound is known nothing is flagged.
    """
    cited = citations(prose, [*keys, *(place or [])])
    known = bounds.withColumn("_known", F.lit(True))
    joined = cited.join(known, keys, "left")
    if union_keys:
        widest = bounds.groupBy(*union_keys).agg(F.max("bound").alias("_widest"))
        joined = joined.join(widest, union_keys, "left").withColumn(
            "bound", F.when(F.col("_known"), F.col("bound")).otherwise(F.col("_widest"))
        ).drop("_widest")
    outside = ~F.col("cited_page").between(F.lit(1), F.col("bound"))
    return joined.filter(F.col("bound").isNotNull() & outside).drop("_known")


def _tokens(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """One row per different number of a text with its unit; the text itself is not carried along.

    Matching runs once per pattern; cleaning runs on the exploded tokens, in generated code. A token
    that ends like a number has no unit.
    """
    found = F.concat(
        F.regexp_extract_all("text", F.lit(PAIR), F.lit(0)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    )
    tokens = rows.select(*keys, F.explode(F.array_distinct(found)).alias("_t"))
    bare = F.right("_t", F.lit(1)).isin(*"0123456789,")
    value = F.when(bare, F.col("_t")).otherwise(F.regexp_extract("_t", "^(" + T.NUMBER + ")", 1))
    unit = F.when(bare, F.lit("")).otherwise(F.regexp_extract("_t", "(" + _UNIT + ")$", 1))
    return tokens.select(*keys, value.alias("value"), unit.alias("unit"))


def prose_numbers(prose: DataFrame, keys: list[str], min_digits: int = 2) -> DataFrame:
    """Numbers a text claims: any with a risky unit, and bare ones of two or more digits."""
    digits = F.length(F.translate("value", ",.", ""))
    return _tokens(prose, keys, BARE).filter((F.col("unit") != "") | (digits >= min_digits)).withColumn(
        "norm", T.plain_number("value")
    )


def corpus_numbers(corpus: DataFrame, doc: list[str]) -> DataFrame:
    """Distinct numbers a document's sources contain, bare and with units."""
    raw = _tokens(corpus, doc, T.NUMBER).distinct()
    return raw.select(*doc, T.plain_number("value").alias("norm"), "unit").distinct()


def scoring_numbers(scoring: DataFrame, doc: list[str]) -> DataFrame:
    """Points and weights are grounded too; a weight also as a percentage."""
    points = T.plain_number(F.col("points").cast("string"))
    weight = T.plain_number(F.col("weight_pct").cast("string"))
    rows = F.array(
        F.struct(points.alias("norm"), F.lit("").alias("unit")),
        F.struct(weight.alias("norm"), F.lit("").alias("unit")),
        F.struct(weight.alias("norm"), F.lit("%").alias("unit")),
    )
    return scoring.select(*doc, F.inline(rows)).filter(F.col("norm").isNotNull()).distinct()


def ungrounded_numbers(
    prose: DataFrame, corpus: DataFrame, doc: list[str], field: str = "field",
    scoring: DataFrame | None = None,
) -> DataFrame:
    """Numbers of the prose that its document's sources do not contain, once per field."""
    known = corpus_numbers(corpus, doc)
    if scoring is not None:
        known = known.unionByName(scoring_numbers(scoring, doc)).distinct()
    claimed = prose_numbers(prose, [*doc, field]).select(*doc, field, "norm", "unit")
    # what the sources hold goes first: the exchange of the join serves the rest too
    return claimed.join(known, [*doc, "norm", "unit"], "left_anti").distinct()


def with_context(
    flags: DataFrame, prose: DataFrame, keys: list[str], needle: str, before: int = 18, after: int = 12
) -> DataFrame:
    """Text around the first occurrence of each flagged value, for people to check.

    Texts are joined to the flags only; they never travel with every number or citation.
    """
    texts = prose.select(*keys, F.col("text").alias("_text")).dropDuplicates(keys)
    found = flags.join(texts, keys, "left").withColumn("_at", F.expr(f"locate({needle}, _text)"))
    start = F.greatest(F.col("_at") - before, F.lit(1))
    context = F.when(
        F.col("_at") > 0,
        F.trim(F.substring("_text", start, F.col("_at") - start + F.length(needle) + after)),
    )
    return found.withColumn("context", context).drop("_text", "_at")


def unanchored_claims(items: DataFrame, keys: list[str], min_digits: int = 2) -> DataFrame:
    """Items without basis whose text states a number; the first such number per text.

    ``items`` has keys, basis ARRAY<STRING>, text.
    """
    empty = ~F.coalesce(
        F.exists("basis", lambda b: F.trim(F.coalesce(b, F.lit(""))) != ""), F.lit(False)
    )
    many = "(?:[\\d][,.]*){" + str(min_digits) + ",}"
    # leftmost number with enough digits, or any number that a risky unit follows
    pattern = (
        r"((?<!\d)(?<!\d[,.])(?=" + many + r")\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?(?=\s*(?:" + _UNIT + ")))"
    )
    value = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    start = F.greatest(F.expr("locate(value, text)") - 18, F.lit(1))
    return (
        items.filter(empty)
        .withColumn("value", value)
        .filter(F.col("value").isNotNull())
        .withColumn("context", F.substring("text", start, F.length("value") + 36))
        .select(*keys, "value", "context")
    )


def emphasis_sentences(items: DataFrame, doc: list[str], ordinal: str = "ord") -> DataFrame:
    """Guideline texts with an emphasis marker, each text once, at its first place."""
    marked = items.withColumn("marker", T.first_marker("text", fixed.EMPHASIS_MARKERS)).filter(
        F.col("marker").isNotNull()
    )
    rest = [c for c in marked.columns if c not in [*doc, "text"]]
    return marked.groupBy(*doc, "text").agg(
        F.min_by(F.struct(*rest), F.col(ordinal)).alias("_p")
    ).select(*doc, "text", "_p.*")


def category_weights(items: DataFrame, doc: list[str]) -> DataFrame:
    """Guideline items and distinct sections per category."""
    category = F.coalesce(T.blank_to_null("category"), F.lit("(미분류)"))
    return items.withColumn("category", category).groupBy(*doc, "category").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct(T.blank_to_null("section")).alias("sections"),
    )


def placement_sentences(items: DataFrame, doc: list[str], ordinal: str = "ord", limit: int | None = None) -> DataFrame:
    """Sentences that state where a programme part belongs, whole, in order; all or the first ``limit``."""
    text = F.trim("text")
    placed = items.filter((F.length(text) >= 6) & T.contains_any(text, fixed.PLACEMENT_WORDS)).groupBy(
        *doc, text.alias("text")
    ).agg(F.min(ordinal).alias("place"))
    order = Window.partitionBy(*doc).orderBy("place")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def differentiator_parts(lines: DataFrame, axis_labels: dict[str, str] | None = None) -> DataFrame:
    """'axis: body — insight' split into its parts."""
    line = F.trim("text")
    head = F.trim(F.regexp_extract(line, r"(?s)^([^:]*):", 1))
    named = (
        line.contains(":") & (head != "") & (F.length(head) <= 20)
        & ~head.contains("당선작") & ~head.contains("낙선작")
    )
    rest = F.when(named, F.trim(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))).otherwise(line)
    axis = F.when(named, head).otherwise(F.lit(""))
    for key, label in (axis_labels or {}).items():
        axis = F.when(axis == key, F.lit(label)).otherwise(axis)
    separator = (
        F.when(rest.contains(" — "), F.lit(" — "))
        .when(rest.contains(" – "), F.lit(" – "))
        .when(rest.contains("—"), F.lit("—"))
        .when(rest.contains("–"), F.lit("–"))
    )
    out = lines.withColumn("axis", axis).withColumn("_rest", rest).withColumn("_sep", separator)
    body = F.when(F.col("_sep").isNull(), F.col("_rest")).otherwise(
        F.expr("substring(_rest, 1, locate(_sep, _rest) - 1)")
    )
    insight = F.when(F.col("_sep").isNull(), F.lit("")).otherwise(
        F.expr("substring(_rest, locate(_sep, _rest) + length(_sep))")
    )
    return out.withColumn("body", F.trim(body)).withColumn("insight", F.trim(insight)).drop("_rest", "_sep")
