"""Queries on resolution, merging and maintenance of records."""

from pyspark.sql import functions as F

from dossierlake.functions import numbers as N
from dossierlake.functions import text as T
from dossierlake.operators import conflicts, resolve
from dossierlake.plans.adapters import Tables
from dossierlake.plans.registry import query
from dossierlake.sources import readers, upserts


def _stated(t: Tables):
    """Measures stated by four kinds of pages of an order."""
    base = t.sql("SELECT l_orderkey AS doc_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ordinal, * FROM lineitem")
    areas = base.filter("l_linenumber = 1").select(
        "doc_id", "ordinal", F.col("l_quantity").alias("site_area_sqm"),
        F.expr("CASE WHEN l_discount > 0.05 THEN l_extendedprice END").alias("building_area_sqm"),
    )
    plans = base.filter("l_linenumber = 2").select(
        "doc_id", "ordinal", F.expr("l_quantity + 1000").alias("site_area_sqm"),
        F.col("l_extendedprice").alias("total_floor_area_sqm"),
    )
    programme = base.filter("l_linenumber = 3").select(
        "doc_id", "ordinal", F.col("l_extendedprice").alias("total_required_floor_area_sqm"),
        F.col("l_quantity").alias("required_parking"),
        F.expr("CASE WHEN l_tax > 0.04 THEN l_quantity END").alias("building_coverage_limit_pct"),
    )
    rules = base.filter("l_linenumber = 4").select(
        "doc_id", "ordinal", F.col("l_quantity").alias("building_coverage_ratio_limit_pct"),
        F.col("l_extendedprice").alias("floor_area_ratio_limit_pct"),
    )
    key = ["doc_id"]
    return (
        resolve.stated_measures(areas, key, resolve.AREA_TABLE, "ordinal")
        .unionByName(resolve.stated_measures(plans, key, resolve.SITE_PLAN, "ordinal"))
        .unionByName(resolve.stated_measures(programme, key, resolve.PROGRAMME, "ordinal"))
        .unionByName(resolve.stated_measures(rules, key, resolve.REGULATIONS, "ordinal"))
    )


STATED = """
base AS (SELECT l_orderkey AS doc_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ordinal, * FROM lineitem),
stated AS (
  SELECT doc_id, 'site_area_sqm' AS field, l_quantity AS value, 0 AS rank, ordinal FROM base WHERE l_linenumber = 1
  UNION ALL SELECT doc_id, 'building_area_sqm', l_extendedprice, 0, ordinal FROM base WHERE l_linenumber = 1 AND l_discount > 0.05E0
  UNION ALL SELECT doc_id, 'site_area_sqm', l_quantity + 1000, 1, ordinal FROM base WHERE l_linenumber = 2
  UNION ALL SELECT doc_id, 'total_floor_area_sqm', l_extendedprice, 1, ordinal FROM base WHERE l_linenumber = 2
  UNION ALL SELECT doc_id, 'total_floor_area_sqm', l_extendedprice, 2, ordinal FROM base WHERE l_linenumber = 3
  UNION ALL SELECT doc_id, 'parking_count', l_quantity, 2, ordinal FROM base WHERE l_linenumber = 3
  UNION ALL SELECT doc_id, 'building_coverage_ratio_pct', l_quantity, 2, ordinal FROM base WHERE l_linenumber = 3 AND l_tax > 0.04E0
  UNION ALL SELECT doc_id, 'building_coverage_ratio_pct', l_quantity, 3, ordinal FROM base WHERE l_linenumber = 4
  UNION ALL SELECT doc_id, 'floor_area_ratio_pct', l_extendedprice, 3, ordinal FROM base WHERE l_linenumber = 4)"""


@query(
    "measure_resolution", "",
    STATED.replace("base AS", "WITH base AS", 1) + """
    SELECT doc_id, field, value, rank AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rank, ordinal) AS r FROM stated) WHERE r = 1""",
)
def measure_resolution(t: Tables):
    return resolve.resolve_measures(_stated(t), ["doc_id"])


@query(
    "headline_fallback", "site_rows",
    """c AS (SELECT doc_id, 'height' AS metric, max_height_m AS value, 0 AS rank FROM site_rows WHERE ord % 2 = 0 AND ord % 3 = 0
      UNION ALL SELECT doc_id, 'height', ord % 2, 1 + ord FROM site_rows)
    SELECT doc_id, metric, arg_min(value, rank) AS value FROM (
      SELECT doc_id, metric, min(value) AS value, rank FROM c WHERE value IS NOT NULL AND value <> 0 GROUP BY doc_id, metric, rank) GROUP BY ALL""",
)
def headline_fallback(t: Tables):
    stated = t.sql(
        """SELECT doc_id, 'height' AS metric, max_height_m AS value, CAST(0 AS BIGINT) AS source_rank FROM site_rows WHERE ord % 2 = 0 AND ord % 3 = 0
           UNION ALL SELECT doc_id, 'height', CAST(ord % 2 AS DOUBLE), 1 + ord FROM site_rows""",
        "site_rows",
    ).groupBy("doc_id", "metric", "source_rank").agg(F.min(F.nullif(F.col("value"), F.lit(0.0))).alias("value"))
    return resolve.headline(stated, ["doc_id"]).select("doc_id", "metric", "value")


@query(
    "site_percentages", "site_rows",
    """v AS (SELECT * FROM site_rows WHERE building_coverage_pct IS NOT NULL)
    SELECT doc_id, CASE WHEN count(*) = 1 THEN any_value(CAST(CAST(building_coverage_pct AS BIGINT) AS VARCHAR))
      ELSE string_agg(coalesce(nullif(trim(site_id), ''), '부지' || ord) || ': ' || CAST(building_coverage_pct AS BIGINT) || '%', ' / ' ORDER BY ord) END AS stated
    FROM v GROUP BY doc_id""",
)
def site_percentages(t: Tables):
    sites = t.view("site_rows").withColumn("building_coverage_pct", F.col("building_coverage_pct").cast("bigint"))
    return resolve.per_site_percentages(sites, ["doc_id"], "building_coverage_pct", "ord")


@query(
    "first_wins_merge", "site_rows",
    """SELECT doc_id, arg_min(site_area_sqm, ord) FILTER (WHERE site_area_sqm IS NOT NULL) AS site_area_sqm,
      arg_min(max_height_m, ord) FILTER (WHERE max_height_m IS NOT NULL) AS max_height_m,
      arg_min(building_coverage_pct, ord) FILTER (WHERE building_coverage_pct IS NOT NULL) AS building_coverage_pct
    FROM site_rows GROUP BY doc_id""",
)
def first_wins_merge(t: Tables):
    return resolve.first_wins(
        t.view("site_rows"), ["doc_id"], "ord", ["site_area_sqm", "max_height_m", "building_coverage_pct"]
    )


@query(
    "multi_file_merge", "site_rows",
    """v AS (SELECT doc_id, 'zoning' AS key, zoning AS value, ord FROM site_rows UNION ALL SELECT doc_id, 'facility', facility, ord FROM site_rows)
    SELECT doc_id, key, arg_min(value, ord) AS value, min(ord) AS source FROM v WHERE trim(value) <> '' GROUP BY ALL""",
)
def multi_file_merge(t: Tables):
    long = t.sql(
        "SELECT doc_id, 'zoning' AS key, zoning AS value, ord FROM site_rows UNION ALL SELECT doc_id, 'facility', facility, ord FROM site_rows",
        "site_rows",
    )
    return resolve.first_wins_long(long, ["doc_id", "key"], "ord")


@query(
    "site_merge", "site_rows",
    """k AS (SELECT *, trim(regexp_replace(trim(coalesce(nullif(site_id, ''), '단일부지')), '\\s*\\([^)]*\\)\\s*$', '')) AS sid FROM site_rows
            WHERE ord % 5 <> 1 OR site_id IS NOT NULL),
    z AS (SELECT *, CASE WHEN ord % 4 = 0 THEN NULL ELSE site_area_sqm END AS sa, CASE WHEN ord % 4 = 0 THEN NULL ELSE max_height_m END AS mh FROM k),
    m AS (SELECT doc_id, sid AS site_id, min(ord) AS first_seen, arg_min(sa, ord) FILTER (WHERE sa IS NOT NULL) AS site_area_sqm,
            arg_min(mh, ord) FILTER (WHERE mh IS NOT NULL) AS max_height_m FROM z GROUP BY ALL),
    f AS (SELECT *, regexp_matches(site_id, '^부지\\d+') AS num, (coalesce(site_area_sqm, 0) <> 0 OR coalesce(max_height_m, 0) <> 0) AS filled FROM m),
    n AS (SELECT *, count(*) FILTER (WHERE num) OVER (PARTITION BY doc_id) AS nums FROM f),
    kept AS (SELECT * FROM n WHERE nums < 2 OR num),
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, count(*) FILTER (WHERE filled) OVER (PARTITION BY doc_id) AS full_n FROM kept)
    SELECT doc_id, site_id, first_seen, site_area_sqm, max_height_m FROM c WHERE total < 2 OR full_n = 0 OR filled""",
)
def site_merge(t: Tables):
    rows = t.view("site_rows").filter("ord % 5 <> 1 OR site_id IS NOT NULL")
    for c in ("site_area_sqm", "max_height_m"):
        rows = rows.withColumn(c, F.when(F.col("ord") % 4 != 0, F.col(c)))
    return resolve.merge_sites(rows, ["doc_id"], "ord", ["site_area_sqm", "max_height_m"])


@query(
    "ordered_union", "site_rows",
    "SELECT doc_id, facility, min(ord) AS first_seen FROM site_rows WHERE facility IS NOT NULL GROUP BY ALL",
)
def ordered_union(t: Tables):
    return resolve.ordered_union(t.view("site_rows"), ["doc_id"], "facility", "ord")


@query(
    "row_supplement", "",
    """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, l_returnflag AS label, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord, l_quantity AS v, 0 AS rank
        FROM lineitem WHERE l_linestatus = 'O'
        UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber, l_quantity, 1 FROM lineitem WHERE l_linestatus = 'F')
    SELECT doc_id, block, label, v, source_rank FROM (SELECT *, rank AS source_rank,
      row_number() OVER (PARTITION BY doc_id, block, label ORDER BY rank, ord) AS r FROM p) WHERE r = 1""",
)
def row_supplement(t: Tables):
    rows = t.sql(
        """SELECT l_orderkey AS doc_id, l_linenumber AS block, l_returnflag AS label, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord,
           l_quantity AS v, l_linestatus FROM lineitem"""
    )
    split = {s: rows.filter(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("O", "F")}
    out = resolve.row_supplement(split["O"], split["F"], ["doc_id", "block", "label"], "ord")
    return out.drop("ord")


@query(
    "keyed_merge", "",
    """WITH o AS (SELECT p_partkey AS name, p_name AS title, p_type AS content, CAST(p_size AS VARCHAR) AS ef_yd FROM part WHERE p_size < 40),
    n AS (SELECT p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS title,
          CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand || '!' END AS content,
          CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN NULL ELSE '20240101' END AS ef_yd FROM part WHERE p_size > 20)
    SELECT coalesce(o.name, n.name) AS name, coalesce(nullif(n.title, ''), o.title) AS title,
      coalesce(nullif(n.content, ''), o.content) AS content, coalesce(n.ef_yd, o.ef_yd) AS ef_yd
    FROM o FULL JOIN n ON o.name = n.name""",
)
def keyed_merge(t: Tables):
    old = t.sql("SELECT p_partkey AS name, p_name AS title, p_type AS content, CAST(p_size AS STRING) AS ef_yd FROM part WHERE p_size < 40")
    new = t.sql(
        """SELECT p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS title,
           CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand || '!' END AS content,
           CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN NULL ELSE '20240101' END AS ef_yd FROM part WHERE p_size > 20"""
    )
    return resolve.keyed_merge(old, new, ["name"], ["title", "content"], ["ef_yd"])


@query(
    "guideline_tree", "guideline_items",
    """heads AS (SELECT doc_id, page, entry, arg_min(trim(facility_scope), item) AS a, arg_min(trim(space_scope), item) AS b,
        arg_min(trim(section_path), item) AS c, arg_min(text, item) AS d FROM guideline_items GROUP BY ALL),
    kept AS (SELECT doc_id, page, entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b, c, d ORDER BY page, entry) AS r FROM heads) WHERE r = 1),
    flat AS (SELECT g.doc_id, coalesce(nullif(g.facility_scope, ''), '전체') AS facility_scope, g.space_scope, coalesce(nullif(g.category, ''), '기타') AS category,
        [trim(x) for x in string_split(g.section_path, '>') if trim(x) <> ''] AS seg, g.label, trim(g.text) AS text, g.page, g.entry, g.item
      FROM guideline_items g JOIN kept USING (doc_id, page, entry) WHERE trim(g.text) <> ''),
    named AS (SELECT *, coalesce(seg[1], '') AS section, array_to_string(seg[2:], ' > ') AS sub_path FROM flat),
    meta AS (SELECT doc_id, facility_scope, section, arg_min(space_scope, row(page, entry, item)) AS space_scope,
        arg_min(category, row(page, entry, item)) AS category FROM named GROUP BY ALL)
    SELECT n.doc_id, n.facility_scope, n.section, n.sub_path, n.label, n.text, any_value(m.space_scope) AS space_scope, any_value(m.category) AS category
    FROM named n JOIN meta m USING (doc_id, facility_scope, section) GROUP BY n.doc_id, n.facility_scope, n.section, n.sub_path, n.label, n.text""",
)
def guideline_tree(t: Tables):
    out = resolve.normalise_guidelines(t.view("guideline_items"), ["doc_id"])
    return out.drop("place")


FILES = """
files AS (SELECT o_custkey AS doc_id, o_orderkey AS file_no,
    CASE WHEN o_orderkey % 3 = 0 THEN '공고_' || CAST(240000 + o_orderkey % 900 AS STRING) || '.pdf'
         WHEN o_orderkey % 3 = 1 THEN CAST(20240000 + o_orderkey % 900 AS STRING) || '지침.pdf' ELSE '과업.pdf' END AS file_name,
    o_orderpriority, o_orderstatus, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 3 AS DOUBLE) AS number FROM orders),
vals AS (
  SELECT doc_id, 'quantitative' AS kind, 'parking' AS key, file_no, file_name, number, CAST(NULL AS STRING) AS text FROM files WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT doc_id, 'site', '부지1.site_area_sqm', file_no, file_name, number + 1, NULL FROM files WHERE o_orderstatus = 'F'
  UNION ALL SELECT doc_id, 'block', 'brief_project_info', file_no, file_name, NULL, repeat('사업 개요와  대지의 조건 ', 40) || o_orderpriority || '  ' || o_orderstatus FROM files
  UNION ALL SELECT doc_id, 'block', 'brief_program', file_no, file_name, NULL, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END FROM files)"""


LOST = """
    stated AS (SELECT * FROM vals WHERE number IS NOT NULL OR text IS NOT NULL),
    w AS (SELECT doc_id, kind, key, min(file_no) AS w_no, arg_min(file_name, file_no) AS w_name, arg_min(number, file_no) AS w_num,
          arg_min(regexp_replace(text, '\\s+', ' ', 'g'), file_no) AS w_text FROM stated GROUP BY ALL),
    base AS (SELECT doc_id, min(file_no) AS base FROM vals GROUP BY doc_id),
    dated AS (SELECT s.*, w.w_no, w.w_num, w.w_text, base.base,
        CASE WHEN s.file_name LIKE '공고%' THEN '20' || substr(s.file_name, 4, 6) WHEN s.file_name LIKE '20%' THEN substr(s.file_name, 1, 8) ELSE '' END AS day,
        CASE WHEN w.w_name LIKE '공고%' THEN '20' || substr(w.w_name, 4, 6) WHEN w.w_name LIKE '20%' THEN substr(w.w_name, 1, 8) ELSE '' END AS w_day
      FROM stated s JOIN w USING (doc_id, kind, key) JOIN base USING (doc_id)),
    lost AS (SELECT * FROM dated WHERE file_no > w_no AND CASE WHEN kind = 'block' THEN w_no = base AND regexp_replace(text, '\\s+', ' ', 'g') <> w_text
        ELSE abs(number - w_num) > 1e-9 END)"""


@query(
    "file_conflicts", "",
    "WITH " + FILES.strip() + "," + LOST + """
    SELECT doc_id, kind, key, w_no AS chosen_file, file_no AS other_file, day <> '' AND w_day <> '' AND day > w_day AS later_differs
    FROM lost WHERE NOT (key = 'brief_project_info' AND doc_id IN (SELECT doc_id FROM lost WHERE kind = 'site'))""",
)
def file_conflicts(t: Tables):
    vals = t.sql("WITH " + FILES + " SELECT * FROM vals")
    return conflicts.file_conflicts(vals, ["doc_id"], shown=False)


@query(
    "conflict_flags", "",
    "WITH " + FILES.strip() + "," + LOST + """
    SELECT doc_id, kind, key, w_no AS chosen_file, count(*) AS others, bool_or(day <> '' AND w_day <> '' AND day > w_day) AS later_differs
    FROM lost WHERE NOT (key = 'brief_project_info' AND doc_id IN (SELECT doc_id FROM lost WHERE kind = 'site')) GROUP BY ALL""",
)
def conflict_flags(t: Tables):
    vals = t.sql("WITH " + FILES + " SELECT * FROM vals")
    rows = conflicts.file_conflicts(vals, ["doc_id"], shown=False)
    return conflicts.conflict_flags(rows, ["doc_id"]).select("doc_id", "kind", "key", "chosen_file", "others", "later_differs")


SOURCES = """
m AS (SELECT o_custkey AS doc_id, 'site_area_sqm' AS field, CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT) % 9000) AS DOUBLE) AS value FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'total_floor_area_sqm', CAST(MAX(CAST(FLOOR(o_totalprice) AS BIGINT) % 50000) AS DOUBLE) FROM orders GROUP BY o_custkey)"""


@query(
    "source_contradictions", "site_rows",
    SOURCES.strip() + """,
    src AS (SELECT doc_id, field AS quantity, value FROM m
      UNION ALL SELECT doc_id, 'site_area_sqm', sum(site_area_sqm) FROM site_rows WHERE site_area_sqm IS NOT NULL GROUP BY doc_id
      UNION ALL SELECT doc_id, 'total_floor_area_sqm', arg_min(floor_area_sqm, ord) FROM site_rows WHERE floor_area_sqm IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, quantity, count(*) AS sources, min(value) AS low, max(value) AS high, round_even(max(value) / nullif(min(value), 0), 2) AS spread_ratio
    FROM src WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND max(value) - min(value) > greatest(1, max(value) * 0.01E0)""",
)
def source_contradictions(t: Tables):
    sites = t.view("site_rows")
    measures = t.sql("WITH " + SOURCES + " SELECT * FROM m")
    programme = sites.select("doc_id", F.col("ord").alias("page"), F.col("floor_area_sqm").alias("total_required_floor_area_sqm"))
    sources = conflicts.quantity_sources(measures, {"project_sites": sites}, programme, ["doc_id"])
    return conflicts.contradictions(sources, ["doc_id"])


@query(
    "variant_items", "",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 2 = 0 AS wrapped FROM events
       UNION ALL SELECT event_id, event_id::INTEGER, true FROM events WHERE event_id % 2 = 0""",
)
def variant_items(t: Tables):
    v = t.sql("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[' || props || ',{\"k\":' || event_id || '}]' ELSE props END AS j, event_id % 2 = 0 AS wrapped FROM events")
    items = v.select("event_id", "wrapped", F.explode(resolve.variant_items(F.parse_json("j"))).alias("v"))
    return items.select("event_id", N.strict_number(F.variant_get("v", "$.k", "variant")).cast("int").alias("k"), "wrapped")


@query(
    "json_salvage", "",
    """SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def json_salvage(t: Tables):
    raw = t.sql(
        """SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '```json\\n' || props || '\\n```'
             WHEN 2 THEN 'Here it is: ' || props || ' done' WHEN 3 THEN replace(props, '}', ',}')
             WHEN 4 THEN '```\\n' || props || '\\n``` bye' WHEN 5 THEN 'so ' || replace(props, '}', ' , }') ELSE 'no ' || replace(props, '{', '') END AS text
           FROM events"""
    )
    out = readers.salvage_json(raw)
    return out.select("event_id", F.try_variant_get("record", "$.k", "int").alias("k"))


@query(
    "project_upsert", "",
    """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tags, CAST(c_nationkey AS VARCHAR) AS created_at FROM customer WHERE c_nationkey < 15),
    n AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_acctbal < 0 THEN '' ELSE 'new' END AS tags, 'now' AS created_at FROM customer WHERE c_nationkey > 10)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(nullif(n.tags, ''), o.tags) AS tags, coalesce(o.created_at, n.created_at) AS created_at
    FROM o FULL JOIN n ON o.id = n.id""",
)
def project_upsert(t: Tables):
    old = t.sql("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tags, CAST(c_nationkey AS STRING) AS created_at FROM customer WHERE c_nationkey < 15")
    new = t.sql("SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_acctbal < 0 THEN '' ELSE 'new' END AS tags, 'now' AS created_at FROM customer WHERE c_nationkey > 10")
    return upserts.upsert_projects(old, new, ["id"], ["tags"])


@query(
    "project_enrich", "",
    """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN coalesce(nullif(c_mktsegment, 'BUILDING'), '') ELSE c_name END AS memo
       FROM customer""",
)
def project_enrich(t: Tables):
    old = t.sql("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS memo FROM customer")
    extra = t.sql("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS memo FROM customer")
    return upserts.enrich_projects(old, extra, ["id"], ["memo"])


CHANGES = """SELECT doc_id, competition_id, facility_type, CASE WHEN price > 300000 THEN 'win' ELSE 'lose' END AS result,
            CASE WHEN priority = '1-URGENT' THEN 'delete' ELSE 'upsert' END AS op, doc_id AS seq
            FROM subs WHERE created_at >= '2000-01-01'"""


@query(
    "stale_refresh", "subs",
    "changes AS (" + CHANGES + """), live AS (SELECT s.facility_type, s.result FROM subs s WHERE s.doc_id NOT IN (SELECT doc_id FROM changes)
      UNION ALL SELECT facility_type, result FROM changes WHERE op = 'upsert')
    SELECT facility_type, count(*) AS submissions, count(*) FILTER (WHERE result IN ('win', 'contracted')) AS winners
    FROM live WHERE facility_type IN (SELECT facility_type FROM changes) GROUP BY facility_type""",
)
def stale_refresh(t: Tables):
    from dossierlake.operators import patterns
    from dossierlake.streaming import refresh

    table = t.view("subs").select("doc_id", "competition_id", "facility_type", "result")
    batch = t.sql(CHANGES, "subs")
    touched = refresh.affected(table, batch, ["doc_id"])
    scope = table.join(touched, "facility_type", "left_semi")
    merged = refresh.apply_changes(scope, batch, ["doc_id"])
    projects = patterns.project_rollup(merged)
    return patterns.facility_rollup(projects).select("facility_type", "submissions", "winners")


@query(
    "delete_records", "subs",
    "SELECT doc_id, facility_type FROM subs WHERE competition_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def delete_records(t: Tables):
    gone = t.sql("SELECT c_custkey AS competition_id FROM customer WHERE c_acctbal < 0")
    return upserts.delete_keys(t.view("subs"), gone, ["competition_id"]).select("doc_id", "facility_type")


@query(
    "schema_backfill", "addresses",
    """n AS (SELECT doc_id, list(address ORDER BY ord) AS a FROM addresses GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS before, len(a) AS after FROM n
    WHERE len(a) > CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END""",
)
def schema_backfill(t: Tables):
    new = t.view("addresses").groupBy("doc_id").agg(F.collect_list("address").alias("addresses"))
    old = new.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.slice("addresses", 1, 1)).alias("addresses"))
    return upserts.backfill(old, new, ["doc_id"]).select("doc_id", "before", "after")


@query(
    "project_ids", "",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) || '_' || regexp_replace(trim(regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z_\\s가-힣-]', '', 'g')), '\\s+', '_', 'g') AS competition_id,
       upper(strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d')) AS day FROM part""",
)
def project_ids(t: Tables):
    parts = t.sql("SELECT p_partkey, p_size, p_name || ' (' || p_brand || ')' AS name, date_add(DATE '2024-01-01', p_size) AS d FROM part")
    return parts.select(
        "p_partkey", T.record_id(F.col("p_size"), F.col("name")).alias("competition_id"),
        T.legal_date(F.date_format("d", "yyyyMMdd")).alias("day"),
    )


@query(
    "duplicate_ids", "",
    "SELECT p_type AS facility_type, p_size || '_' || replace(p_name, ' ', '_') AS competition_id, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(t: Tables):
    ids = t.table("part").select(
        F.col("p_type").alias("facility_type"), T.record_id(F.col("p_size"), F.col("p_name")).alias("competition_id")
    )
    return upserts.duplicate_ids(ids)


@query(
    "report_listing", "",
    """SELECT CASE WHEN event_id % 5 = 0 THEN 'short_' || event_id || '.html'
        ELSE strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type || '_vs_u' || user_id || '_' || event_id || '.html' END AS filename,
      CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at,
      CASE WHEN event_id % 5 = 0 THEN 'short_' || event_id ELSE event_type || '|u' || user_id || '_' || event_id END AS labels,
      event_id % 2 = 0 AS has_data FROM events""",
)
def report_listing(t: Tables):
    names = t.sql(
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'short_' || event_id
           ELSE date_format(ts, 'yyyyMMdd_HHmmss') || '_' || event_type || '_vs_u' || user_id || '_' || event_id END AS stem FROM events"""
    )
    html = names.select(F.concat(F.lit("/reports/"), "stem", F.lit(".html")).alias("path"))
    data = names.filter("event_id % 2 = 0").select(F.concat(F.lit("/reports/"), "stem", F.lit(".json")).alias("path"))
    return readers.report_names(html.unionByName(data)).withColumn("labels", F.array_join("labels", "|"))
