"""Queries over nested records: field pruning and the digests of briefs, contexts and insights."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import nested
from dossierlake.operators import resolve, sheets
from dossierlake.plans.adapters import Tables
from dossierlake.plans.registry import query
from dossierlake.sources import files, readers, upserts


@query(
    "field_pruning", "",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.absent') IS NOT NULL AS has_absent FROM events""",
)
def field_pruning(t: Tables):
    records = t.sql("SELECT event_id, parse_json(props) AS record FROM events")
    pruned = readers.prune_fields(records, "record", ["k", "absent"])
    return pruned.select("event_id", F.try_variant_get("k", "$", "bigint").alias("k"), F.col("absent").isNotNull().alias("has_absent"))


@query(
    "measured_context", "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '구역' || o_custkey END AS region, o_orderstatus AS use_type,
       CAST(500 + o_custkey % 7 AS DOUBLE) AS radius_m, CASE WHEN o_orderkey % 3 = 0 THEN '소음|1|거리 ' || o_custkey ELSE '소음|1' END AS drivers,
       CAST(o_orderkey % 3 AS BIGINT) AS facts, CAST(o_orderdate AS VARCHAR)[1:10] AS base_date FROM orders""",
)
def measured_context(t: Tables):
    raw = t.sql(
        """SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '"region":"구역' || o_custkey || '",' END ||
             '"use_type":"' || o_orderstatus || '","radius":' || (500 + o_custkey % 7) || ',"unread":[1,2],"design_drivers":[{"rank":1,"name":"소음","evidence":[' ||
             CASE WHEN o_orderkey % 3 = 0 THEN '{"key":"d","detail":"거리 ' || o_custkey || '"}' ELSE '' END || ']}],"key_facts":[' ||
             array_join(transform(slice(array(0, 1, 2), 1, CAST(o_orderkey % 3 AS INT)), i -> '{"item":"인구","value":"' || i || '"}'), ',') ||
             '],"base_date":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"}' AS j FROM orders"""
    ).withColumn("brief", F.parse_json("j"))
    out = readers.measured_digest(raw, ["o_orderkey"])
    driver = F.get("design_drivers", F.lit(0))
    return out.select(
        "o_orderkey", "region", "use_type", "radius_m",
        F.concat_ws("|", driver["name"], driver["rank"].cast("string"), F.get(driver["evidence"], F.lit(0))["detail"]).alias("drivers"),
        F.size("key_facts").cast("long").alias("facts"), "base_date",
    )


@query(
    "prior_insight", "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '요약 ' || o_custkey END AS synthesis_summary,
       '동선:' || o_orderpriority AS emphases, CASE WHEN o_orderkey % 2 = 0 THEN '주차|' || o_orderstatus ELSE o_orderstatus END AS must_not_miss FROM orders""",
)
def prior_insight(t: Tables):
    raw = t.sql(
        """SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '"synthesis_summary":"요약 ' || o_custkey || '",' END ||
             '"key_emphases":[{"topic":"동선","signal_strength":"' || o_orderpriority || '","page":3}],"must_not_miss":[' ||
             CASE WHEN o_orderkey % 2 = 0 THEN '{"item":"주차"},' ELSE '' END || '{"item":"' || o_orderstatus || '"}]}' AS j FROM orders"""
    ).withColumn("insight", F.parse_json("j"))
    out = readers.insight_digest(raw, ["o_orderkey"])
    emphasis = F.get("key_emphases", F.lit(0))
    return out.select(
        "o_orderkey", "synthesis_summary", F.concat_ws(":", emphasis["topic"], emphasis["signal_strength"]).alias("emphases"),
        F.array_join("must_not_miss", "|").alias("must_not_miss"),
    )


@query(
    "brief_digest", "",
    """SELECT CAST(o_orderkey AS VARCHAR) || '_brief' AS brief_id, '공모 ' || o_custkey AS brief_name, o_orderstatus AS facility_type,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'bid' END AS genre, CAST(o_custkey % 5 AS INT) AS high,
       CAST(o_custkey AS DOUBLE) AS site_area, o_orderkey % 2 = 0 AS has_insight, false AS has_proposal, o_orderkey % 5 = 0 AS has_contradictions FROM orders""",
)
def brief_digest(t: Tables):
    raw = t.sql(
        """SELECT CAST(o_orderkey AS STRING) || '_brief.json' AS file_name,
             '{"_brief_meta":{"brief_name":"공모 ' || o_custkey || '","facility_type":"' || o_orderstatus || '"},' ||
             CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"_brief_genre":{"genre":"bid"},' END || '"_quantitative":{"site_area_sqm":' || o_custkey || '},' ||
             '"validation":{"summary":{"high":' || (o_custkey % 5) || '}},"_proposal":{},"_insight":' ||
             CASE WHEN o_orderkey % 2 = 0 THEN '{"scoring_focus":[1]}' ELSE '{}' END || ',"_contradictions":' ||
             CASE WHEN o_orderkey % 5 = 0 THEN '[{"q":1}]' ELSE '[]' END || '}' AS j FROM orders"""
    ).withColumn("record", F.parse_json("j"))
    out = readers.brief_summary(raw)
    return out.select(
        "brief_id", "brief_name", "facility_type", "genre", F.col("validation_summary")["high"].alias("high"),
        F.try_variant_get("quantitative", "$.site_area_sqm", "double").alias("site_area"),
        F.col("has.insight").alias("has_insight"), F.col("has.proposal").alias("has_proposal"),
        F.col("contradictions").isNotNull().alias("has_contradictions"),
    )


# an event's record with its key order and the depth of its pages depending on the event
NESTED = """
nested AS (SELECT user_id, event_id, CASE event_id % 4
    WHEN 0 THEN '{"kind": "' || event_type || '", "_page": ' || CAST(event_id % 40 AS STRING) || ', "items": [{"_page": ' || CAST(event_id % 70 AS STRING) || '}]}'
    WHEN 1 THEN '{"items": [{"deep": {"_page": ' || CAST(event_id % 70 AS STRING) || '.0}, "text": "a \\\\"_page\\\\":99 b"}], "kind": "' || event_type || '"}'
    WHEN 2 THEN '{"total_pages": ' || CAST(event_id % 30 AS STRING) || ', "_page": "x", "kind": "' || event_type || '"}'
    ELSE '{"kind":"' || event_type || '","b":' || CAST(event_id % 3 AS STRING) || ',"a":[1,2]}' END AS record FROM events)"""


@query(
    "nested_pages", "",
    """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN greatest(event_id % 40, event_id % 70) WHEN 1 THEN event_id % 70
         WHEN 2 THEN CASE WHEN event_id % 30 > 0 THEN event_id % 30 END END AS BIGINT) AS bound,
       CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS pages FROM events""",
)
def nested_pages(t: Tables):
    rows = t.sql("WITH " + NESTED + " SELECT * FROM nested")
    return rows.select("event_id", nested.page_bound("record").alias("bound"), F.size(nested.page_numbers("record")).alias("pages"))


@query(
    "distinct_records", "",
    """WITH r AS (SELECT user_id, event_id, CASE event_id % 2 WHEN 0 THEN event_type || '|' || event_id % 3 ELSE event_type || '|' || event_id % 3 END AS same FROM events)
    SELECT user_id, min(event_id) AS event_id, count(*) AS copies FROM r GROUP BY user_id, same""",
)
def distinct_records(t: Tables):
    rows = t.sql(
        """SELECT user_id, event_id, CASE event_id % 2 WHEN 0 THEN '{"t": "' || event_type || '", "n": {"x": ' || CAST(event_id % 3 AS STRING) || ', "y": [1]}}'
           ELSE '{"n":{"y":[1],"x":' || CAST(event_id % 3 AS STRING) || '},"t":"' || event_type || '"}' END AS record FROM events"""
    )
    return resolve.distinct_records(rows, ["user_id"], "record", "event_id").drop("record")


@query(
    "backfill_apply", "",
    """SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_custkey % 3 = 1 OR (o_custkey % 3 = 0) THEN 'new ' || o_orderkey ELSE 'old ' || o_orderkey END AS address, o_custkey % 5 AS part FROM orders""",
)
def backfill_apply(t: Tables):
    """Address lists after a dry run and two applications: documents gain addresses (one in three),
    are new (one in three) or lose some and stay."""
    path = f"{files.shared_folder(t.spark)}/addresses-{uuid.uuid4().hex}"
    every = t.sql("SELECT o_custkey AS doc_id, o_orderkey AS ord, o_custkey % 5 AS part, 'old ' || CAST(o_orderkey AS STRING) AS address FROM orders")
    old = every.withColumn("address", F.when(F.col("doc_id") % 3 == 2, F.col("address")).otherwise(F.lit(" ")))
    upserts.write_partitions(old.where("doc_id % 3 <> 0"), path, "part")
    new = every.withColumn("address", F.regexp_replace("address", "old", "new"))
    new = new.withColumn("address", F.when(F.col("doc_id") % 3 == 2, F.lit("")).otherwise(F.col("address")))
    upserts.apply_backfill(t.spark, path, new, ["doc_id"], "address", "part", dry_run=True)
    for _ in range(2):
        upserts.apply_backfill(t.spark, path, new, ["doc_id"], "address", "part", dry_run=False)
    return t.spark.read.parquet(path).select("doc_id", "ord", "address", F.col("part").cast("long").alias("part"))


# --- checklist sheets ----------------------------------------------------------------

SHEETS = """
sh AS (SELECT l_orderkey AS doc_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord, l_returnflag AS category, l_linestatus AS detail,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS points, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' WHEN 'R' THEN NULL END AS severity,
    l_discount, CASE l_linenumber WHEN 1 THEN 'site_total' WHEN 2 THEN 'facility' WHEN 3 THEN 'bureau' WHEN 4 THEN 'division' WHEN 5 THEN 'other' END AS row_type FROM lineitem)"""


@query(
    "checklist_sheets", "",
    "WITH " + SHEETS.strip() + """,
    fl AS (SELECT doc_id, ord, coalesce(severity, 'low') AS sev, detail FROM sh WHERE l_discount > 0.07),
    al AS (SELECT o_orderkey AS doc_id, count(*) FILTER (WHERE sev = 'high') AS h, count(*) FILTER (WHERE sev = 'medium') AS m, count(*) FILTER (WHERE sev = 'low') AS l, count(sev) AS n
        FROM orders LEFT JOIN fl ON doc_id = o_orderkey GROUP BY ALL)
    SELECT doc_id, '2.심사기준' AS sheet, 1 AS part, ord, CASE WHEN lag(category) OVER (PARTITION BY doc_id ORDER BY ord) = category THEN NULL ELSE category END AS label, detail AS text, CAST(points AS DOUBLE) AS amount FROM sh
    UNION ALL SELECT doc_id, '2.심사기준', 2, 0, '합계', NULL, sum(points) FROM sh GROUP BY doc_id
    UNION ALL SELECT doc_id, '3.요구사항', 1, ord, category, detail, l_discount FROM sh
    UNION ALL SELECT doc_id, '4.검증경고', 0, 0, '높음', NULL, h FROM al UNION ALL SELECT doc_id, '4.검증경고', 0, 1, '보통', NULL, m FROM al
    UNION ALL SELECT doc_id, '4.검증경고', 0, 2, '낮음', NULL, l FROM al
    UNION ALL SELECT doc_id, '4.검증경고', 1, 0, NULL, '검출된 경고 없음', NULL FROM al WHERE n = 0
    UNION ALL SELECT doc_id, '4.검증경고', CASE sev WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord, CASE sev WHEN 'high' THEN '높음' WHEN 'medium' THEN '보통' ELSE '낮음' END, detail, NULL FROM fl
    UNION ALL SELECT doc_id, '5.면적표상세', 1, ord, CASE row_type WHEN 'site_total' THEN '부지' WHEN 'facility' THEN '시설' WHEN 'bureau' THEN '영역' WHEN 'division' THEN '과' ELSE '세부' END,
        CASE row_type WHEN 'site_total' THEN '' WHEN 'facility' THEN '  ' WHEN 'bureau' THEN '    ' WHEN 'division' THEN '      ' ELSE '        ' END || category,
        coalesce(points, l_discount) FROM sh""",
)
def checklist_sheets(t: Tables):
    rows = t.sql("WITH " + SHEETS + " SELECT * FROM sh")
    docs = t.table("orders").select(F.col("o_orderkey").alias("doc_id"))
    parts = sheets.checklist(
        docs, rows.select("doc_id", "ord", "category", "detail", "points"),
        rows.select("doc_id", "ord", F.col("category").alias("axis"), F.col("detail").alias("description"), F.col("l_discount").alias("weight")),
        rows.where("l_discount > 0.07").select("doc_id", "ord", "severity", F.col("detail").alias("message")),
        rows.select("doc_id", "ord", "row_type", F.col("category").alias("name"), F.col("points").alias("area"), F.col("l_discount").alias("subtotal_area")), ["doc_id"],
    )
    return reduce(DataFrame.unionByName, parts.values())
