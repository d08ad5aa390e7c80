"""Queries on page rules, completeness, runs and merging."""

from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.operators import pages
from dossierlake.plans.adapters import Tables
from dossierlake.plans.registry import query

TYPES = ", ".join(f"'{p}'" for p in fixed.PAGE_TYPES)
RULE = f"""CASE WHEN type NOT IN ({TYPES}) THEN 'CONCEPT'
    WHEN confidence < 0.65E0 AND type = 'COMMUNITY_PROGRAM' THEN 'SPECIAL_SPACE'
    WHEN confidence < 0.65E0 AND type = 'BUSINESS_VIABILITY' THEN 'AREA_TABLE' ELSE type END"""
RULED = f"ruled AS (SELECT *, {RULE} AS primary_type FROM cls)"

BRIEF = """
b AS (SELECT doc_id, page, trim(page_header_text) AS h, has_scoring_table AS sc, value,
   CASE WHEN type = 'NOTICE' THEN 'BRIEF_DESIGN_GUIDE' ELSE type END AS k FROM brief_pages),
b2 AS (SELECT *, CASE WHEN sc AND k NOT IN ('BRIEF_EVALUATION', 'BRIEF_PROGRAM') THEN 'BRIEF_EVALUATION'
   WHEN NOT sc AND k = 'BRIEF_EVALUATION' THEN 'BRIEF_ADMIN' ELSE k END AS k2 FROM b),
brief AS (SELECT doc_id, page, h, value, CASE
   WHEN k2 = 'BRIEF_EVALUATION' AND regexp_matches(h, '결과\\s*발표|\\[\\s*서식|확인\\s*서|부\\s*록|공\\s*고($|[^0-9A-Za-z_가-힣])|(^|[^0-9A-Za-z_가-힣])상\\s*품($|[^0-9A-Za-z_가-힣])')
     THEN 'BRIEF_ADMIN'
   WHEN k2 = 'BRIEF_PROJECT_INFO' AND regexp_matches(h, '\\[\\s*서식|부\\s*록') THEN 'BRIEF_SUBMISSION'
   ELSE k2 END AS primary_type FROM b2)"""


def _ruled(t: Tables):
    return t.view("cls").withColumn("primary_type", pages.submission_type())


def _brief(t: Tables):
    return t.view("brief_pages").withColumn("primary_type", pages.brief_type())


@query("page_rules", "cls", RULED + " SELECT doc_id, page, type, confidence, primary_type FROM ruled")
def page_rules(t: Tables):
    return _ruled(t).select("doc_id", "page", "type", "confidence", "primary_type")


@query("brief_page_rules", "brief_pages", BRIEF + " SELECT doc_id, page, primary_type FROM brief")
def brief_page_rules(t: Tables):
    return _brief(t).select("doc_id", "page", "primary_type")


@query(
    "route_counts", "cls",
    RULED + """, routed AS (SELECT primary_type, CASE
      WHEN primary_type = 'COVER' THEN 'skip'
      WHEN quantity * 4 >= 80 AND NOT (primary_type IN ('AREA_TABLE', 'BUSINESS_VIABILITY') AND confidence >= 0.7E0) THEN 'digital'
      WHEN quantity * 9 >= 80 AND primary_type IN ('AREA_TABLE', 'BUSINESS_VIABILITY') AND confidence >= 0.7E0 THEN 'ocr'
      WHEN primary_type IN ('AREA_TABLE', 'BUSINESS_VIABILITY') AND confidence >= 0.7E0 THEN 'tiled'
      ELSE 'vision' END AS route FROM ruled)
    SELECT primary_type, route, count(*) AS pages FROM routed GROUP BY ALL""",
)
def route_counts(t: Tables):
    routed = (
        _ruled(t)
        .withColumn("digital_chars", F.col("quantity") * 4)
        .withColumn("ocr_chars", F.col("quantity") * 9)
        .withColumn("route", pages.extraction_route())
    )
    return pages.route_counts(routed, ["primary_type"])


@query(
    "page_merge", "cls",
    RULED + """, c AS (SELECT doc_id, page, arg_min(primary_type, ord) AS primary_type FROM ruled GROUP BY ALL),
    e AS (SELECT doc_id, page, arg_max(quantity, ord) AS payload FROM cls WHERE quantity > 10 GROUP BY ALL)
    SELECT c.doc_id, c.page, c.primary_type, e.payload FROM c LEFT JOIN e USING (doc_id, page)""",
)
def page_merge(t: Tables):
    ruled = _ruled(t)
    ext = ruled.filter("quantity > 10").select("doc_id", "page", "ord", F.col("quantity").alias("payload"))
    cls = ruled.select("doc_id", "page", "primary_type", F.col("ord").alias("c_ord"))
    out = pages.classified_extractions(cls, ext, ["doc_id", "page"], F.col("c_ord"), F.col("ord"))
    return out.select("doc_id", "page", "primary_type", "payload")


@query(
    "merge_by_type", "cls",
    RULED + """, c AS (SELECT doc_id, page, arg_min(primary_type, ord) AS primary_type FROM ruled GROUP BY ALL)
    SELECT doc_id, primary_type, count(*) AS count, min(page) AS first_page, max(page) AS last_page FROM c GROUP BY ALL""",
)
def merge_by_type(t: Tables):
    cls = _ruled(t).select("doc_id", "page", "primary_type", "ord")
    first = pages.first_per_page(cls, ["doc_id", "page"], F.col("ord"))
    return pages.merge_by_type(first, ["doc_id"])


@query(
    "type_members", "cls",
    RULED + """, c AS (SELECT doc_id, page, arg_min(primary_type, ord) AS primary_type FROM ruled GROUP BY ALL)
    SELECT doc_id, primary_type, page, row_number() OVER (PARTITION BY doc_id, primary_type ORDER BY page) AS seq FROM c""",
)
def type_members(t: Tables):
    cls = _ruled(t).select("doc_id", "page", "primary_type", "ord")
    first = pages.first_per_page(cls, ["doc_id", "page"], F.col("ord")).select("doc_id", "page", "primary_type")
    return pages.type_members(first, ["doc_id"])


@query(
    "page_spine", "cls",
    RULED + """, d AS (SELECT doc_id, max(page) AS n FROM cls GROUP BY doc_id),
    spine AS (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INT) AS page FROM d),
    r AS (SELECT doc_id, page, arg_max(primary_type, ord) AS primary_type, arg_max(confidence, ord) AS confidence
          FROM ruled WHERE quantity > 5 GROUP BY ALL)
    SELECT doc_id, page, coalesce(r.primary_type, 'CONCEPT') AS primary_type, coalesce(r.confidence, 0) AS confidence,
           r.primary_type IS NULL AS defaulted FROM spine LEFT JOIN r USING (doc_id, page)""",
)
def page_spine(t: Tables):
    ruled = _ruled(t)
    docs = ruled.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    return pages.page_spine(docs, ruled.filter("quantity > 5"), ["doc_id"], F.col("ord"))


@query(
    "contiguous_runs", "brief_pages",
    BRIEF + """, design AS (SELECT doc_id, primary_type, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page FROM brief),
    lagged AS (SELECT *, lag(primary_type) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM design),
    numbered AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND before = primary_type THEN 0 ELSE 1 END)
        OVER (PARTITION BY doc_id ORDER BY page) AS run FROM lagged)
    SELECT doc_id, run, primary_type, min(page) AS first_page, max(page) AS last_page, count(*) AS pages
    FROM numbered GROUP BY ALL""",
)
def contiguous_runs(t: Tables):
    from dossierlake.operators import scan

    brief = _brief(t).select("doc_id", F.col("page").alias("event"), "primary_type")
    dense = scan.positions(brief, ["doc_id"], "event", "event", name="page")
    return pages.contiguous_runs(dense.select("doc_id", "page", "primary_type"), ["doc_id"])


@query(
    "design_runs", "brief_pages",
    BRIEF + """, dense AS (SELECT doc_id, primary_type, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page FROM brief),
    design AS (SELECT * FROM dense WHERE primary_type LIKE 'BRIEF_DESIGN%'),
    islands AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM design)
    SELECT doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM islands GROUP BY doc_id, g""",
)
def design_runs(t: Tables):
    from dossierlake.operators import scan

    brief = _brief(t).select("doc_id", F.col("page").alias("event"), "primary_type")
    dense = scan.positions(brief, ["doc_id"], "event", "event", name="page")
    runs = pages.design_runs(dense.select("doc_id", "page", "primary_type"), ["doc_id"])
    return runs.select("doc_id", "first_page", "last_page", "pages")


@query(
    "scoring_stack", "brief_pages",
    BRIEF + """, dense AS (SELECT doc_id, primary_type, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page FROM brief),
    s AS (SELECT * FROM dense WHERE primary_type = 'BRIEF_EVALUATION')
    SELECT doc_id, page, primary_type, false AS is_tail FROM s
    UNION ALL SELECT d.doc_id, d.page, d.primary_type, true FROM dense d
    WHERE d.primary_type IN ('BRIEF_SUBMISSION', 'BRIEF_DESIGN_GUIDE')
      AND EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.page + 1 = d.page)""",
)
def scoring_stack(t: Tables):
    from dossierlake.operators import scan

    brief = _brief(t).select("doc_id", F.col("page").alias("event"), "primary_type")
    dense = scan.positions(brief, ["doc_id"], "event", "event", name="page")
    return pages.scoring_stack(dense, ["doc_id"])


@query("low_confidence", "cls", "SELECT doc_id, page, ord, confidence FROM cls WHERE confidence < 0.55E0")
def low_confidence(t: Tables):
    return pages.low_confidence(t.view("cls")).select("doc_id", "page", "ord", "confidence")


@query(
    "form_pages", "brief_pages",
    """s AS (SELECT doc_id, page, CASE WHEN page_header_text LIKE '%서식%' THEN 1
        WHEN regexp_matches(page_header_text, '^\\s*\\d+\\s*[.\\-]') OR page_header_text LIKE '%공간구성%' THEN 0 END AS st FROM brief_pages),
    f AS (SELECT doc_id, page, last_value(st IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM s)
    SELECT doc_id, page FROM f WHERE st = 1""",
)
def form_pages(t: Tables):
    return pages.form_pages(t.view("brief_pages"), ["doc_id"]).select("doc_id", "page")
