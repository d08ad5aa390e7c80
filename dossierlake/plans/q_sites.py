"""Queries on site facts, area tables and geometry."""

from pyspark.sql import functions as F

from dossierlake.functions import geo, labels, numbers
from dossierlake.operators import areas, sites
from dossierlake.plans.adapters import Tables
from dossierlake.plans.adapters import r4 as R4
from dossierlake.plans.registry import query, r4

ZONE = """CASE WHEN ord % 5 = 0 THEN '제2종일반주거지역' WHEN ord % 5 = 1 THEN '준공업지역' END"""


@query(
    "zone_uses", "site_rows",
    f"SELECT doc_id, ord, {ZONE} AS zone_use, CASE WHEN ord % 5 IN (2, 3) THEN zoning END AS zone_use_raw FROM site_rows",
)
def zone_uses(t: Tables):
    return t.view("site_rows").select(
        "doc_id", "ord", sites.zone_use("zoning").alias("zone_use"), sites.zone_use_raw("zoning").alias("zone_use_raw")
    )


@query(
    "building_uses", "site_rows",
    """SELECT doc_id, CASE WHEN bool_or(ord % 4 = 1) THEN CASE WHEN bool_or(ord % 4 = 0) THEN
         CASE WHEN min(ord) FILTER (WHERE ord % 4 = 0) < min(ord) FILTER (WHERE ord % 4 = 1) THEN '노유자시설|업무시설|공동주택' ELSE '업무시설|공동주택|노유자시설' END
         ELSE '업무시설|공동주택' END WHEN bool_or(ord % 4 = 0) THEN '노유자시설' ELSE '' END AS uses FROM site_rows GROUP BY doc_id""",
)
def building_uses(t: Tables):
    grouped = t.view("site_rows").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "facility"))), lambda x: x.facility).alias("facilities")
    )
    return grouped.select("doc_id", F.array_join(sites.building_uses("facilities"), "|").alias("uses"))


@query(
    "certifications", "",
    """WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 5 AS m, o_orderkey % 2 AS h, o_orderkey % 5 + 1 AS z FROM orders)
    SELECT doc_id, arg_max(CASE WHEN h = 0 THEN '최우수' ELSE '우수' END, ord) FILTER (WHERE m = 0) AS green_building,
      CAST(arg_max(ord % 4 + 1, ord) FILTER (WHERE m = 1) AS INT) AS zeb_grade,
      arg_max(CASE WHEN h = 0 THEN '최우수' ELSE '우수' END, ord) FILTER (WHERE m = 2) AS bf_grade FROM c GROUP BY doc_id""",
)
def certifications(t: Tables):
    certs = t.sql(
        """SELECT o_custkey AS doc_id, o_orderkey AS ord,
           CASE o_orderkey % 5 WHEN 0 THEN '녹색건축 인증' WHEN 1 THEN 'zeb 인증' WHEN 2 THEN '장애물 없는 생활환경' ELSE '에너지효율' END AS name,
           CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 4 + 1 AS STRING) || ' 등급'
                WHEN o_orderkey % 2 = 0 THEN '최우수' ELSE '우수' END AS required_grade FROM orders"""
    )
    return sites.certifications(certs, ["doc_id"])


@query(
    "feasibility_projects", "",
    """WITH b AS (SELECT o_custkey AS doc_id, max(o_orderkey) AS k, CAST(count(*) AS DOUBLE) AS n, max(o_totalprice) AS top, min(o_totalprice) AS least FROM orders GROUP BY o_custkey),
    c AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 5 AS m, o_orderkey % 2 AS h FROM orders),
    g AS (SELECT doc_id, arg_max(CASE WHEN h = 0 THEN '최우수' ELSE '우수' END, ord) FILTER (m = 0) AS green_building, CAST(arg_max(ord % 4 + 1, ord) FILTER (m = 1) AS INT) AS zeb_grade,
      arg_max(CASE WHEN h = 0 THEN '최우수' ELSE '우수' END, ord) FILTER (m = 2) AS bf_grade FROM c GROUP BY doc_id)
    SELECT doc_id, CASE k % 4 WHEN 0 THEN CAST(k % 40 AS DOUBLE) WHEN 1 THEN (k % 40) + 0.5E0 END AS renewable_pct, green_building, zeb_grade, bf_grade,
      top AS construction_cost_100m_won, least AS design_cost_100m_won, n AS construction_period_months FROM b JOIN g USING (doc_id)""",
)
def feasibility_projects(t: Tables):
    briefs = t.sql(
        """SELECT o_custkey AS doc_id, max(o_totalprice) AS construction_cost_100m_won, min(o_totalprice) AS design_cost_100m_won,
           CAST(count(*) AS DOUBLE) AS construction_period_months, max(o_orderkey) AS k FROM orders GROUP BY o_custkey"""
    )
    share = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"renewable_energy_min_pct": '), F.col("k") % 40, F.lit("}")))
    share = share.when(F.col("k") % 4 == 1, F.concat(F.lit('{"renewable_energy_min_pct": '), F.col("k") % 40, F.lit(".5}")))
    share = share.when(F.col("k") % 4 == 2, F.lit('{"renewable_energy_min_pct": "20"}')).otherwise(F.lit('{"other": 1}'))
    certs = t.sql(
        """SELECT o_custkey AS doc_id, o_orderkey AS ord,
           CASE o_orderkey % 5 WHEN 0 THEN '녹색건축 인증' WHEN 1 THEN 'zeb 인증' WHEN 2 THEN '장애물 없는 생활환경' ELSE '에너지효율' END AS name,
           CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 4 + 1 AS STRING) || ' 등급'
                WHEN o_orderkey % 2 = 0 THEN '최우수' ELSE '우수' END AS required_grade FROM orders"""
    )
    return sites.feasibility_projects(briefs.withColumn("sustain", F.parse_json(share)).drop("k"), certs, ["doc_id"])


PARKING = """
park AS (SELECT doc_id, ord, text, CASE ord % 6 WHEN 0 THEN ord % 900 WHEN 1 THEN 2001000 + ord % 800 + 100 ELSE ord % 70 END AS cnt,
   CASE WHEN ord % 6 = 0 THEN '부지' || (ord % 3 + 1) END AS site_id FROM statements WHERE ord % 6 IN (0, 1))"""


@query(
    "parking_requirements", "statements",
    PARKING + " SELECT doc_id, ord, CAST(cnt AS INT) AS count, site_id, ord % 6 = 1 AS is_total FROM park",
)
def parking_requirements(t: Tables):
    return sites.parking_statements(t.view("statements"), ["doc_id"]).drop("text")


ADDR = """
addr AS (SELECT doc_id, site_id, arg_min(address, (ord, pos)) AS address FROM (
    SELECT doc_id, ord, 0 AS pos, '부지1' AS site_id, '서울특별시 중구 세종로 ' || ord AS address FROM addresses WHERE ord % 3 = 0
    UNION ALL SELECT doc_id, ord, 1, '부지2', '서울특별시 중구 태평로 ' || doc_id FROM addresses WHERE ord % 3 = 0
    UNION ALL SELECT doc_id, ord, 0, '부지3', '역삼동 ' || ord FROM addresses WHERE ord % 3 = 1) GROUP BY ALL)"""


@query("address_inherit", "addresses", ADDR.replace("(ord, pos)", "row(ord, pos)") + " SELECT * FROM addr")
def address_inherit(t: Tables):
    return sites.site_addresses(t.view("addresses"), ["doc_id"])


def _feasibility(t: Tables):
    rows = t.view("site_rows")
    base = rows.select(
        "doc_id", "ord", F.regexp_replace("site_id", r"\s*\(.*", "").alias("site_id"),
        F.when(F.col("ord") % 8 == 0, F.concat(F.lit("종로 "), "ord")).alias("address"),
        "zoning", F.array("facility").alias("facilities"),
        "site_area_sqm", "building_coverage_pct", "floor_area_ratio_pct", "max_height_m", "floor_area_sqm",
    )
    statements = t.view("statements")
    return sites.feasibility_sites(base, t.view("addresses"), statements, statements, ["doc_id"])


FEAS = ADDR.replace("(ord, pos)", "row(ord, pos)") + "," + PARKING + f""",
base AS (SELECT doc_id, ord, coalesce(regexp_replace(site_id, '\\s*\\(.*', ''), '부지' || ord) AS sid,
    CASE WHEN ord % 8 = 0 THEN '종로 ' || ord END AS own, * EXCLUDE (doc_id, ord, site_id) FROM site_rows),
psite AS (SELECT doc_id, site_id, arg_min(cnt, ord) AS cnt FROM park WHERE site_id IS NOT NULL GROUP BY ALL),
rev AS (SELECT doc_id, bool_or(ord % 6 = 3) AS review FROM statements GROUP BY doc_id),
feas AS (SELECT b.doc_id, b.ord, b.sid AS site_id, coalesce(b.own, a.address) AS address, p.cnt AS parking, {ZONE.replace('ord', 'b.ord')} AS zone_use,
    CASE WHEN b.ord % 5 IN (2, 3) THEN b.zoning END AS zone_use_raw, b.ord % 4 AS uses_of, b.facility,
    CASE WHEN coalesce(r.review, false) THEN '심의' ELSE '법정' END AS limits_determined_by, site_area_sqm, building_coverage_pct, floor_area_ratio_pct, max_height_m
  FROM base b LEFT JOIN addr a ON a.doc_id = b.doc_id AND a.site_id = b.sid LEFT JOIN psite p ON p.doc_id = b.doc_id AND p.site_id = b.sid
  LEFT JOIN rev r ON r.doc_id = b.doc_id)"""


@query(
    "feasibility_sites", "site_rows addresses statements",
    FEAS + """ SELECT doc_id, site_id, address, CAST(parking AS INT) AS required_parking_count, zone_use, limits_determined_by, site_area_sqm,
      CASE uses_of WHEN 0 THEN '노유자시설' WHEN 1 THEN '업무시설|공동주택' ELSE '' END AS uses FROM feas""",
)
def feasibility_sites(t: Tables):
    return _feasibility(t).select(
        "doc_id", "site_id", "address", "required_parking_count", "zone_use", "limits_determined_by", "site_area_sqm",
        F.array_join("building_law_uses", "|").alias("uses"),
    )


@query(
    "diagnosis_requests", "site_rows addresses statements",
    FEAS + f""" SELECT doc_id, site_id, address, CASE uses_of WHEN 0 THEN '노유자시설' WHEN 1 THEN '업무시설' ELSE coalesce(zone_use_raw, '미상') END AS building_use,
      {R4('site_area_sqm * building_coverage_pct / 100')} AS building_area,
      CAST(greatest(1, round_even(max_height_m / 4.0E0, 0)) AS INT) AS floors_above FROM feas
      WHERE coalesce(trim(address), '') <> '' AND site_area_sqm <> 0 AND building_coverage_pct <> 0 AND floor_area_ratio_pct <> 0 AND max_height_m <> 0""",
)
def diagnosis_requests(t: Tables):
    out = sites.diagnosis_requests(_feasibility(t), ["doc_id", "site_id"])
    return out.select("doc_id", "site_id", "address", "building_use", r4("building_area").alias("building_area"), "floors_above")


@query(
    "diagnosis_digest", "",
    """SELECT o_orderkey, CAST(o_custkey % 60 AS DOUBLE) AS bcr_limit_pct, CASE WHEN o_orderkey % 2 = 0 THEN '교통영향평가' ELSE '' END AS reviews,
       (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS low_confidence, CASE WHEN o_orderkey % 2 = 0 THEN '법1|법2' ELSE '법1' END AS refs FROM orders""",
)
def diagnosis_digest(t: Tables):
    raw = t.sql(
        """SELECT o_orderkey, '{"signal":"ok","results":{"건폐율":{"limit_pct":' || CAST(o_custkey % 60 AS STRING) || ',"pass":' ||
             CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE 'true' END || ',"law_refs":[{"name":"법1"}]},"용적률":{"limit_pct":250,"pass":false,"source":"' ||
             CASE WHEN o_orderkey % 3 = 0 THEN '추정값' ELSE '조례' END || '"},"높이_일조":{"law_refs":[{"name":"법1"}' ||
             CASE WHEN o_orderkey % 2 = 0 THEN ',{"name":"법2"}' ELSE '' END || ']}},"applicable_reviews":{"items":[{"name":"경관심의","severity":"MAYBE"}' ||
             CASE WHEN o_orderkey % 2 = 0 THEN ',{"name":"교통영향평가","severity":"REQUIRED"}' ELSE '' END || ']}}' AS j FROM orders"""
    ).withColumn("diagnosis", F.parse_json("j"))
    out = sites.diagnosis_digest(raw, ["o_orderkey"])
    return out.select(
        "o_orderkey", "bcr_limit_pct", F.array_join("reviews_required", "|").alias("reviews"), "low_confidence",
        F.array_join("law_refs", "|").alias("refs"),
    )


@query(
    "law_reference_names", "",
    """SELECT o_custkey AS doc_id, o_orderstatus AS name, min(o_orderkey) AS first_order FROM orders GROUP BY ALL""",
)
def law_reference_names(t: Tables):
    digests = t.sql("SELECT o_custkey AS doc_id, o_orderkey AS ord, array(o_orderstatus, ' ') AS law_refs FROM orders")
    out = sites.law_reference_names(digests, ["doc_id"], "ord")
    return out.select("doc_id", "name", F.col("first_seen.ord").alias("first_order"))


@query(
    "effective_labels", "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '시행 ' || strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 3 = 1 THEN '법규 시행 ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS label FROM orders""",
)
def effective_labels(t: Tables):
    rows = t.sql(
        """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN o_orderkey % 3 = 1 THEN '' ELSE '2024' END AS a,
           CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE date_format(o_orderdate, 'yyyyMMdd') END AS b FROM orders"""
    )
    return rows.select("o_orderkey", labels.effective_label("a", "b").alias("label"))


@query(
    "money_labels", "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey >= 10000 THEN format('{:,.1f}', o_custkey / 10000.0E0) || '조'
         WHEN o_orderkey % 3 = 0 AND o_custkey > 0 THEN format('{:,}', CAST(o_custkey AS BIGINT)) || '억'
         WHEN o_orderkey % 3 = 1 THEN '-' || format('{:,}', CAST(o_custkey AS BIGINT) % 9000 + 1) || '만' ELSE format('{:,}', CAST(o_custkey AS BIGINT) % 9999) || '원' END AS label,
         format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS amount FROM orders""",
)
def money_labels(t: Tables):
    rows = t.sql(
        """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 100000000.0D WHEN o_orderkey % 3 = 1 THEN -(o_custkey % 9000 + 1) * 10000.0D
           ELSE CAST(o_custkey % 9999 AS DOUBLE) END AS won, o_totalprice FROM orders"""
    )
    return rows.select("o_orderkey", numbers.money_label("won").alias("label"), numbers.plain_amount(F.floor("o_totalprice").cast("double")).alias("amount"))


AREA = r"""
a0 AS (SELECT doc_id, ord, row_type, name, TRY_CAST(replace(regexp_extract(area, '-?\d[\d,]*\.?\d*'), ',', '') AS DOUBLE) AS ar,
    TRY_CAST(replace(regexp_extract(subtotal_area, '-?\d[\d,]*\.?\d*'), ',', '') AS DOUBLE) AS st FROM area_rows),
a1 AS (SELECT *, CASE WHEN ar > 0 THEN ar END AS area, coalesce(CASE WHEN st > 0 THEN st END, CASE WHEN ar > 0 THEN ar END) AS sub,
    row_type = 'site_total' AND name LIKE '%부지%' AS is_site FROM a0),
multi AS (SELECT DISTINCT doc_id FROM a1 WHERE is_site),
ms AS (SELECT a1.*, last_value(CASE WHEN row_type = 'site_total' THEN CASE WHEN is_site THEN ord ELSE -1 END END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS site FROM a1 JOIN multi USING (doc_id)),
mb AS (SELECT *, max(sub) FILTER (WHERE row_type = 'site_total') OVER (PARTITION BY doc_id, site) AS target,
    min(ord) FILTER (WHERE row_type = 'space') OVER (PARTITION BY doc_id, site) AS detail FROM ms WHERE site >= 0),
mf AS (SELECT *, coalesce(sum(sub) OVER (PARTITION BY doc_id, site ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM mb WHERE row_type = 'facility' AND sub IS NOT NULL AND (detail IS NULL OR ord < detail)),
raw_m AS (SELECT doc_id, site, ord, name, sub AS area FROM mf WHERE target IS NULL OR before < target * 0.995E0),
ss AS (SELECT *, last_value(CASE WHEN row_type = 'facility' THEN ord WHEN row_type = 'site_total' THEN -1 END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM a1 WHERE doc_id NOT IN (SELECT doc_id FROM multi)),
raw_s AS (SELECT doc_id, owner AS ord, max(name) FILTER (WHERE row_type = 'facility') AS name,
    coalesce(max(sub) FILTER (WHERE row_type = 'facility'), sum(area) FILTER (WHERE row_type = 'space')) AS area
  FROM ss WHERE row_type <> 'site_total' AND owner >= 0 GROUP BY doc_id, owner
  UNION ALL SELECT doc_id, ord, name, area FROM ss WHERE row_type <> 'site_total' AND coalesce(owner, -1) < 0),
clean AS (SELECT doc_id, ord, trim(regexp_replace(name, '^[\s·]+', '')) AS name, area FROM (
    SELECT doc_id, ord, name, area FROM raw_m UNION ALL SELECT doc_id, ord, name, area FROM raw_s) WHERE area > 0 AND name NOT LIKE '%계'),
merged AS (SELECT doc_id, name, sum(area) AS area, min(ord) AS place FROM clean GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, place) AS rank, count(*) OVER (PARTITION BY doc_id) AS n,
    sum(area) OVER (PARTITION BY doc_id) AS total FROM merged)"""


@query(
    "area_blocks", "area_rows",
    AREA + """ SELECT doc_id, name, area, rank, total FROM ranked WHERE n >= 2 AND (n <= 3 OR rank < 3)
    UNION ALL SELECT doc_id, '기타 ' || (n - 2) || '개', total - sum(area) FILTER (WHERE rank < 3), 3, total FROM ranked WHERE n > 3 GROUP BY doc_id, n, total""",
)
def area_blocks(t: Tables):
    return areas.programme_blocks(t.view("area_rows"), ["doc_id"], most=3)


@query("hierarchy_stats", "area_rows", "SELECT doc_id, row_type, count(*) AS rows, count(area) AS area_filled FROM area_rows GROUP BY ALL")
def hierarchy_stats(t: Tables):
    return areas.hierarchy_stats(t.view("area_rows"), ["doc_id"])


@query(
    "site_envelopes", "area_rows",
    AREA + f""", geo AS (SELECT o_orderkey AS doc_id, o_orderkey AS ord, CAST(floor(o_totalprice) AS DOUBLE) AS area, CAST(o_orderkey % 50 + 20 AS DOUBLE) AS bcr,
        CAST(o_orderkey % 300 + 100 AS DOUBLE) AS far, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 + 5 AS DOUBLE) END AS h FROM orders),
    bucket AS (SELECT doc_id, site, row_number() OVER (PARTITION BY doc_id ORDER BY site) AS place, sum(area) AS ground FROM raw_m
        WHERE trim(regexp_replace(name, '^[\\s·]+', '')) NOT LIKE '%계' GROUP BY doc_id, site)
    SELECT g.doc_id, {R4('g.area * bcr / 100')} AS footprint, {R4('coalesce(least(far / bcr, h / 4.3E0), far / bcr)')} AS floors,
      CASE WHEN h IS NULL OR far / bcr <= h / 4.3E0 THEN '용적률' ELSE '높이한도' END AS binding, ground AS ground_est,
      {R4('ground / (g.area * bcr / 100 * coalesce(least(far / bcr, h / 4.3E0), far / bcr))')} AS fill
    FROM geo g JOIN bucket b ON b.doc_id = g.doc_id AND b.place = 1""",
)
def site_envelopes(t: Tables):
    limits = t.sql(
        """SELECT o_orderkey AS doc_id, o_orderkey AS ord, CAST(floor(o_totalprice) AS DOUBLE) AS area, CAST(o_orderkey % 50 + 20 AS DOUBLE) AS bcr,
           CAST(o_orderkey % 300 + 100 AS DOUBLE) AS far, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 + 5 AS DOUBLE) END AS h_limit FROM orders"""
    )
    buckets = areas.site_facilities(t.view("area_rows"), ["doc_id"]).select("doc_id", F.col("site").alias("ord"), "name", "area")
    out = areas.site_envelopes(limits, buckets, ["doc_id"])
    return out.select("doc_id", r4("footprint").alias("footprint"), r4("floors").alias("floors"), "binding", "ground_est", r4("fill").alias("fill"))


# a parcel corner per supplier line: longitude and latitude from its numbers
CORNERS = """
corners AS (SELECT l_orderkey AS doc_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord, 126.5E0 + (l_partkey % 1000) / 1000.0E0 AS lng, 37.0E0 + (l_suppkey % 1000) / 1000.0E0 AS lat FROM lineitem)"""
MX = "lng * 20037508.342789244E0 / 180.0E0"
MY = "ln(tan(radians(lat)) + 1.0E0 / cos(radians(lat))) * 20037508.342789244E0 / pi()"


@query(
    "tile_coords", "",
    "WITH " + CORNERS.strip() + f""" SELECT doc_id, ord, CAST(floor((lng + 180.0E0) / 360.0E0 * 65536) AS INT) AS tx,
      CAST(floor((1.0E0 - ln(tan(radians(lat)) + 1.0E0 / cos(radians(lat))) / pi()) / 2.0E0 * 65536) AS INT) AS ty,
      CAST({MX} AS DECIMAL(18,2))::DOUBLE AS mx, CAST({MY} AS DECIMAL(18,2))::DOUBLE AS my FROM corners""",
)
def tile_coords(t: Tables):
    corners = t.sql("WITH " + CORNERS + " SELECT * FROM corners")
    return corners.select(
        "doc_id", "ord", geo.tile_x("lng", 16).alias("tx"), geo.tile_y("lat", 16).alias("ty"),
        geo.metre_x("lng").cast("decimal(18,2)").cast("double").alias("mx"),
        geo.metre_y("lat").cast("decimal(18,2)").cast("double").alias("my"),
    )


@query(
    "ring_projection", "",
    "WITH " + CORNERS.strip() + f""",
    m AS (SELECT doc_id, ord, {MX} AS x, {MY} AS y, CAST(floor((lng + 180.0E0) / 360.0E0 * 65536) AS INT) AS tx,
      CAST(floor((1.0E0 - ln(tan(radians(lat)) + 1.0E0 / cos(radians(lat))) / pi()) / 2.0E0 * 65536) AS INT) AS ty FROM corners),
    e AS (SELECT *, -20037508.342789244E0 + (tx - 1) * (2 * 20037508.342789244E0 / 65536) AS minx, 20037508.342789244E0 - (ty - 1) * (2 * 20037508.342789244E0 / 65536) AS maxy,
      3 * (2 * 20037508.342789244E0 / 65536) AS side FROM m)
    SELECT doc_id, ord, CAST(CAST((x - minx) / side AS DECIMAL(18,3)) AS DOUBLE) AS nx, CAST(CAST((maxy - y) / side AS DECIMAL(18,3)) AS DOUBLE) AS ny FROM e""",
)
def ring_projection(t: Tables):
    corners = t.sql("WITH " + CORNERS + " SELECT * FROM corners")
    bounds = geo.tile_grid_bounds(geo.tile_x("lng", 16), geo.tile_y("lat", 16), 16, 3)
    placed = corners.withColumn("bounds", bounds)
    x = (geo.metre_x("lng") - F.col("bounds.minx")) / (F.col("bounds.maxx") - F.col("bounds.minx"))
    y = (F.col("bounds.maxy") - geo.metre_y("lat")) / (F.col("bounds.maxy") - F.col("bounds.miny"))
    three = lambda c: c.cast("decimal(18,3)").cast("double")
    return placed.select("doc_id", "ord", three(x).alias("nx"), three(y).alias("ny"))


@query(
    "hierarchy_summary", "area_rows",
    """r AS (SELECT doc_id, count(area) AS area_filled, string_agg(DISTINCT row_type, ',' ORDER BY row_type) AS levels FROM area_rows GROUP BY doc_id),
    s AS (SELECT l_orderkey AS doc_id, count(*) AS shared FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
    SELECT doc_id, area_filled, levels, coalesce(shared, 0) AS shared FROM r LEFT JOIN s USING (doc_id)""",
)
def hierarchy_summary(t: Tables):
    shared = t.sql("SELECT l_orderkey AS doc_id, l_partkey AS name FROM lineitem WHERE l_discount > 0.08")
    out = areas.hierarchy_summary(t.view("area_rows"), shared, ["doc_id"])
    return out.withColumn("levels", F.array_join("levels", ","))


@query(
    "whole_area_blocks", "area_rows",
    AREA + " SELECT doc_id, name, area, rank, total FROM ranked WHERE n >= 2",
)
def whole_area_blocks(t: Tables):
    """Every block, without the collecting one."""
    return areas.programme_blocks(t.view("area_rows"), ["doc_id"])
