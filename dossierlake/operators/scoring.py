"""Scoring tables: focus, totals by name, size bands, and reading tables from cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import half_even
from dossierlake.functions.text import blank_to_null
from dossierlake.operators import scan

# fixed values: how size bands and scoring headers are written
HEADER_EXCLUDED = "계산|산출|산정|방법"
HEADER_POINTS = "배점|비중|가중"
HEADER_SCORE = "점수"
HEADER_DETAIL = r"세부|평가\s*사항|평가\s*항목|항목|내용"
UNIT_GUARD_WORDS = ["배점", "심사", "평가", "일정", "시간", "위원"]
UNIT_AREA = r"전\s*용\s*\d+[~\-]?\d*\s*[㎡평]|\d{1,5}[,\d]*\s*[㎡평]|적\s*정\s*(규모|면적)"
UNIT_RATIO = r"\d{1,3}\s*%"
UNIT_BLOCK = (
    r"\d+(?:[,~\-]\d+)*\s*BL|근린\s*생활\s*시설|부대\s*복리\s*시설|공공\s*기여\s*시설"
    r"|^[가-힣A-Za-z]+\s*시설(?:[^가-힣]|$)"
)
UNIT_TENURE = r"\((분양|임대|일반|특별|기타)\)"
UNIT_TYPE = r"^\d+(?:~\d+)?\s*형(?![\w가-힣])"


def scoring_page(categories: DataFrame, doc: list[str]) -> DataFrame:
    """The page with most numeric points per document, the first one on ties."""
    per_page = categories.groupBy(*doc, "page").agg(F.count("points").alias("_n"))
    chosen = per_page.groupBy(*doc).agg(F.max_by("page", F.struct(F.col("_n"), -F.col("page"))).alias("page"))
    return categories.join(chosen, [*doc, "page"], "left_semi")


def scoring_focus(categories: DataFrame, doc: list[str]) -> DataFrame:
    """Weight and rank of every category of the scoring page.

    ``categories`` has doc, page, ord, name, points, shared_with, sub_items, total_points
    and no merged pages.
    """
    chosen = scoring_page(categories, doc)
    totals = chosen.groupBy(*doc).agg(
        F.max("total_points").alias("_total"), F.sum("points").alias("_sum")
    )
    denominator = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.col("_sum"))
    share = F.col("points") / F.nullif(denominator, F.lit(0.0)) * 100
    ranked = scan.positions(
        chosen.filter(F.col("points").isNotNull()).select(*doc, "ord", "points"),
        doc, "points", "ord", descending=True, name="rank", hot=scan.is_hot(categories, doc),
    ).select(*doc, "ord", "rank")
    unshared = F.coalesce(F.size("shared_with"), F.lit(0)) <= 0
    return (
        chosen.join(totals, doc)
        .join(ranked, [*doc, "ord"], "left")
        .select(
            *doc, "ord",
            F.coalesce(blank_to_null("name"), F.concat(F.lit("항목"), F.col("ord"))).alias("category"),
            "points",
            half_even(share, 1).alias("weight_pct"),
            F.greatest(F.coalesce(F.size("sub_items"), F.lit(0)), F.lit(0)).alias("sub_items_count"),
            (F.col("points").isNull() & unshared).alias("is_qualitative"),
            "rank",
        )
    )


def top_scoring(focus: DataFrame, doc: list[str], limit: int | None = None) -> DataFrame:
    """Rank-ordered rows, unranked last, all or the first ``limit``, with the number left out."""
    from pyspark.sql import Window

    order = Window.partitionBy(*doc).orderBy(F.coalesce("rank", F.lit(99)), "ord")
    total = focus.groupBy(*doc).agg(F.count(F.lit(1)).alias("_n"))
    shown = focus.withColumn("place", F.row_number().over(order))
    if limit is not None:
        shown = shown.filter(F.col("place") <= limit)
    return shown.join(total, doc).withColumn(
        "dropped", F.greatest(F.col("_n") - (F.col("_n") if limit is None else F.lit(limit)), F.lit(0))
    ).drop("_n")


def points_by_name(categories: DataFrame, doc: list[str]) -> DataFrame:
    """Points summed per category name, in order of first appearance."""
    return (
        categories.filter(blank_to_null("name").isNotNull())
        .groupBy(*doc, F.trim("name").alias("name"))
        .agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"), F.min("ord").alias("first_seen"))
    )


def axis_role(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return (
        F.when(c.contains("가격"), F.lit("price"))
        .when(c.contains("수행능력") | c.contains("PQ") | c.contains("적격"), F.lit("pq"))
        .otherwise(F.lit("other"))
    )


def basis_dimension(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return (
        F.when(c.contains("연면적"), F.lit("연면적"))
        .when(c.contains("대지면적") | c.contains("부지면적"), F.lit("대지면적"))
        .otherwise(F.lit("unknown"))
    )


def _band(label: Column, weight: Column) -> list[Column]:
    """Limits a label states: under, from, or between two sizes in units of ten thousand."""
    sizes = F.regexp_extract_all(label, F.lit(r"(\d+)\s*만"), F.lit(1))
    first = F.get(sizes, F.lit(0)).cast("double") * 10000.0
    second = F.get(sizes, F.lit(1)).cast("double") * 10000.0
    ranged = label.rlike("[~∼－]") & second.isNotNull()
    under, over = label.contains("미만"), label.contains("이상")
    return [
        label.alias("label"),
        F.when(ranged | (~under & over), first).alias("min_sqm"),
        F.when(ranged, second).when(under, first).alias("max_sqm"),
        weight.alias("weight_pct"),
    ]


def text_bands(statements: DataFrame, doc: list[str]) -> DataFrame:
    """Bands such as '수행능력 (8만㎡ 미만: 20%, 8만~24만㎡: 30%, 24만㎡ 이상: 40%)'.

    ``statements`` has doc, source_rank, ord, text; text without an axis role is skipped.
    """
    inside = F.regexp_extract("text", r"[（(](.+?)[)）]", 1)
    body = F.when(inside == "", F.col("text")).otherwise(inside)
    clause = (
        statements.withColumn("role", axis_role("text"))
        .filter(F.col("role") != "other")
        .select(*doc, "role", "source_rank", "ord", F.posexplode(F.split(body, "[,，]")).alias("pos", "_c"))
        .withColumn("_c", F.trim("_c"))
        .filter(F.col("_c").rlike(r"\d\s*%") & F.col("_c").rlike(r"\d+\s*만"))
    )
    weight = F.regexp_extract("_c", r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    return clause.select(*doc, "role", "source_rank", "ord", "pos", *_band(F.col("_c"), weight))


def method_bands(statements: DataFrame, doc: list[str]) -> DataFrame:
    """Bands stated per size with both axes, as '8만㎡미만(사업수행능력평가 20%, 가격평가 80%)'."""
    pattern = r"([^,()（）]*?(?:미만|이상|~)[^,()（）]*?)\s*[（(]([^)）]*)[)）]"
    sizes = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    clause = statements.select(
        *doc, "source_rank", "ord", F.posexplode(F.arrays_zip(sizes.alias("s"), inner.alias("i"))).alias("pos", "z")
    ).select(*doc, "source_rank", "ord", "pos", F.col("z.s").alias("s"), F.col("z.i").alias("i"))
    exact = F.regexp_extract("s", r"(\d+\s*만[^,()（）]*(?:미만|이상))", 1)
    label = F.trim(F.when(exact == "", F.col("s")).otherwise(exact))
    axis = r"([가-힣]+평가|[가-힣]{3,})\s*(\d+(?:\.\d+)?)\s*%"
    names = F.regexp_extract_all("i", F.lit(axis), F.lit(1))
    weights = F.regexp_extract_all("i", F.lit(axis), F.lit(2))
    rows = clause.select(
        *doc, "source_rank", "ord", "pos", label.alias("label"),
        F.explode(F.arrays_zip(names.alias("n"), weights.alias("w"))).alias("z"),
    )
    return (
        rows.withColumn("role", axis_role(F.col("z.n")))
        .filter(F.col("role") != "other")
        .select(
            *doc, "role", "source_rank", "ord", "pos",
            *_band(F.col("label"), F.col("z.w").cast("double")),
        )
    )


def preferred_bands(bands: DataFrame, doc: list[str]) -> DataFrame:
    """Per role the bands of the best source that states any size limit.

    The bands of one statement form a short list; the lists compete in one aggregate, so
    the texts are read once.
    """
    band = F.struct("pos", "label", "min_sqm", "max_sqm", "weight_pct")
    limited = F.col("min_sqm").isNotNull() | F.col("max_sqm").isNotNull()
    per_statement = bands.groupBy(*doc, "role", "source_rank", "ord").agg(
        F.collect_list(band).alias("_bands"), F.max(limited).alias("_limited")
    ).filter("_limited")
    best = per_statement.groupBy(*doc, "role").agg(
        F.min_by(F.struct("source_rank", "ord", "_bands"), F.struct("source_rank", "ord")).alias("_b")
    )
    return best.select(
        *doc, "role", F.col("_b.source_rank").alias("source_rank"), F.col("_b.ord").alias("ord"), F.inline("_b._bands")
    )


def band_thresholds(bands: DataFrame, doc: list[str]) -> DataFrame:
    limits = F.array("min_sqm", "max_sqm")
    return bands.select(*doc, F.explode(limits).alias("threshold_sqm")).filter(
        F.col("threshold_sqm") > 0
    ).distinct()


def band_lookup(values: DataFrame, bands: DataFrame, doc: list[str]) -> DataFrame:
    """First band per role with min <= value < max; open ends are NULL.

    Bands are matched on the document key, so the range test runs inside an equi-join. A
    document without the basis value gets no band: no other measure stands in for it.
    """
    v = F.col("value")
    inside = (F.col("min_sqm").isNull() | (v >= F.col("min_sqm"))) & (
        F.col("max_sqm").isNull() | (v < F.col("max_sqm"))
    )
    hits = values.filter(v.isNotNull()).join(bands, doc).filter(inside)
    return hits.groupBy(*doc, "role").agg(
        F.min_by(F.struct("value", "label", "weight_pct"), F.struct("ord", "pos")).alias("_h")
    ).select(*doc, "role", "_h.*")


def weight_range(text) -> Column:
    """'60~80%' -> low and high bound."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = r"(\d+(?:\.\d+)?)\s*[~∼－-]\s*(\d+(?:\.\d+)?)\s*%"
    a = F.regexp_extract(c, pattern, 1).try_cast("double")
    b = F.regexp_extract(c, pattern, 2).try_cast("double")
    return F.when(a.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def _header_columns() -> Column:
    """Points and detail column named by a header row, from its list of cells."""

    def rank(c: Column) -> Column:
        return (
            F.when(c.text.rlike(HEADER_EXCLUDED), -1).when(c.text.rlike(HEADER_POINTS), 3)
            .when(c.text.rlike(HEADER_SCORE), 1).otherwise(0)
        )

    ranked = F.filter(
        F.transform("_cells", lambda c: F.struct(rank(c).alias("rank"), (-c.col).alias("left"))), lambda c: c["rank"] > 0
    )
    detail = F.filter("_cells", lambda c: (c.col != 0) & c.text.rlike(HEADER_DETAIL))
    return F.struct(
        (-F.array_max(ranked)["left"]).alias("points_col"), F.get(detail, F.lit(0))["col"].alias("detail_col")
    )


def parse_points(c) -> Column:
    """First number of a cell; fractions up to 1 count as percentages."""
    return _as_points(_first_number(c))


def _first_number(c) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def _as_points(v: Column) -> Column:
    return F.when((v > 0) & (v <= 1.0), v * 100).otherwise(v)


def scoring_rows(cells: DataFrame, table: list[str], hot: bool | None = None) -> DataFrame:
    """Scoring categories read from table cells; subtotal rows are marked.

    ``cells`` has the table key, row (0 is the header), col, text, rowspan; continued cells
    of a vertical merge are blank. A merged points cell makes one category shared by the
    names it spans; a merged name cell makes one category per row. The header and the open
    merges are carried down the rows, so a table is read in one pass.
    """
    hot = scan.is_hot(cells, table) if hot is None else hot
    listed = cells.groupBy(*table, "row").agg(
        F.sort_array(F.collect_list(F.struct("col", F.trim("text").alias("text"), "rowspan"))).alias("_cells")
    )
    headed = scan.carry_last(
        listed, table, "row", {"_h": F.when(F.col("row") == 0, _header_columns())}, hot=hot
    ).filter(F.col("_h.points_col").isNotNull())

    def cell(at: Column) -> Column:
        return F.get(F.filter("_cells", lambda c: c.col == at), F.lit(0))

    named = headed.select(
        *table, "row",
        cell(F.lit(0)).alias("_n"), cell(F.col("_h.detail_col")).alias("_d"), cell(F.col("_h.points_col")).alias("_p"),
        F.exists("_cells", lambda c: c.text != "").alias("_any"),
    )
    first = F.greatest(F.col("row"), F.lit(1))

    def span(prefix: str) -> Column:
        size = F.col(f"_{prefix}.rowspan")
        return F.when(
            size > 1,
            F.struct(first.alias("start"), (F.col("row") + size - 1).alias("end"), F.col(f"_{prefix}.text").alias("value")),
        )

    merged = scan.carry_last(named, table, "row", {"_ns": span("n"), "_ps": span("p")}, hot=hot)

    def inside(prefix: str) -> Column:
        return F.when(F.col("row") <= F.col(f"_{prefix}s.end"), F.col(f"_{prefix}s"))

    body = merged.filter(F.col("_any") & (F.col("row") >= 1)).select(
        *table, "row",
        F.coalesce("_n.text", F.lit("")).alias("name_text"), F.coalesce("_d.text", F.lit("")).alias("detail"),
        _first_number(F.coalesce("_p.text", F.lit(""))).alias("number"), inside("n").alias("n"), inside("p").alias("p"),
    ).withColumns({"n_start": F.col("n.start"), "p_number": _first_number("p.value")})
    # a merged name is read row by row once any of its rows stands outside a merged points cell
    flagged = scan.group_any(body, [*table, "n_start"], F.col("p").isNull(), "_free", hot=hot)
    in_name, in_points = F.col("n").isNotNull(), F.col("p").isNotNull()
    own_name = F.coalesce(F.nullif(F.col("n.value"), F.lit("")), F.col("name_text"))

    def entry(group: Column, points: Column, name: Column, kind: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), group.alias("group"), name.alias("name"), points.alias("points"), F.col("detail").alias("detail")
        )

    shared = F.when(in_points, entry(F.col("p.start"), _as_points(F.col("p_number")), own_name, "shared"))
    per_row = F.when(
        F.when(in_name, F.col("_free")).otherwise(~in_points & (F.col("name_text") != "")),
        entry(F.col("row"), _as_points(F.col("number")), F.trim(F.replace(own_name, F.lit("\n"), F.lit(" "))), "row"),
    )
    entries = flagged.select(*table, "row", F.explode(F.array(shared, per_row)).alias("e")).where(F.col("e").isNotNull())
    grouped = (
        entries.select(*table, "row", "e.*")
        .groupBy(*table, "kind", "group", "points")
        .agg(F.min("row").alias("row"), F.sort_array(F.collect_list(F.struct("row", "name", "detail"))).alias("_m"))
    )
    names = F.array_distinct(F.filter(F.transform("_m", lambda m: m["name"]), lambda n: n != ""))
    details = F.filter(F.transform("_m", lambda m: m["detail"]), lambda d: d != "")
    # names are listed once per category: what reads them takes them from one generated row
    told = F.transform(
        F.array(names),
        lambda l: F.struct(
            F.coalesce(F.get(l, F.lit(0)), F.lit("")).alias("name"), F.col("points").alias("points"),
            F.slice(l, F.lit(2), F.greatest(F.size(l), F.lit(0))).alias("shared_with"), details.alias("sub_items"),
        ),
    )
    out = grouped.select(*table, "row", F.inline(told)).filter((F.col("name") != "") | F.col("points").isNotNull())
    return out.withColumn("is_subtotal", F.col("name").rlike(fixed.SCORING_SUBTOTAL))


def scoring_totals(rows: DataFrame, table: list[str]) -> DataFrame:
    """Explicit total between 95 and 105 if a subtotal row states one, else the sum."""
    stated = F.when(F.col("is_subtotal") & F.col("points").between(95, 105), F.col("points"))
    return rows.groupBy(*table).agg(
        F.max_by(stated, F.when(stated.isNotNull(), F.col("row"))).alias("_explicit"),
        F.sum(F.when(~F.col("is_subtotal"), F.col("points"))).alias("_sum"),
        F.count_if(~F.col("is_subtotal")).alias("categories"),
    ).select(
        *table, "categories",
        F.coalesce("_explicit", F.when(F.col("_sum") > 0, F.col("_sum"))).alias("total_points"),
    )


def unit_programme(cells: DataFrame, table: list[str]) -> DataFrame:
    """Unit mix rows of allocation tables; block and tenure carry down the rows.

    Tables whose header speaks of scoring or schedules are left out.
    """
    guarded = cells.filter(
        (F.col("row") == 0) & F.col("text").rlike("|".join(UNIT_GUARD_WORDS))
    ).select(*table).distinct()
    body = cells.filter(F.col("row") >= 1).join(guarded, table, "left_anti")
    t, c = F.trim("text"), F.col("col")
    other = (c >= 1) & (t != "")

    def leftmost(cond: Column) -> Column:
        return F.coalesce(F.min_by(t, F.when(cond, c)), F.lit(""))

    rows = body.groupBy(*table, "row").agg(
        F.coalesce(F.max(F.when(c == 0, t)), F.lit("")).alias("first"),
        leftmost((c == 1) & t.rlike(UNIT_TYPE)).alias("type_label"),
        leftmost(other & t.rlike(UNIT_AREA)).alias("area_text"),
        leftmost(other & t.rlike(UNIT_RATIO)).alias("ratio_text"),
        F.collect_list(F.when(other, F.struct((-c).alias("c"), t.alias("t")))).alias("_cells"),
    )
    opens = F.col("first").rlike(UNIT_BLOCK)
    carried = scan.carry_last(
        rows, table, "row",
        {
            "block": F.when(opens, F.trim(F.regexp_replace("first", UNIT_TENURE, ""))),
            "tenure": F.when(opens, F.regexp_extract("first", UNIT_TENURE, 1)),
        },
        hot=scan.is_hot(cells, table),
    )
    rest = F.filter(
        F.transform(F.sort_array("_cells"), lambda x: x.t),
        lambda x: ~x.isin("") & (x != F.col("area_text")) & (x != F.col("ratio_text"))
        & (x != F.col("type_label")) & ~x.rlike(UNIT_BLOCK),
    )
    kept = carried.filter(
        (F.coalesce("block", F.lit("")) != "") & ((F.col("area_text") != "") | (F.col("ratio_text") != ""))
    ).withColumn("note", F.coalesce(F.get(rest, F.lit(0)), F.lit("")))
    keys = [*table, "block", "tenure", "type_label", "area_text"]
    return kept.groupBy(*keys).agg(
        F.min_by(F.struct("ratio_text", "note", "row"), "row").alias("_p")
    ).select(*keys, "_p.ratio_text", "_p.note", "_p.row")
