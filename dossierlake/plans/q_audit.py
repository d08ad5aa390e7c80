"""Queries on accuracy, audits and document structure."""

from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.operators import audit, blocks, evaluation
from dossierlake.plans.adapters import Tables
from dossierlake.plans.adapters import r4 as R4
from dossierlake.plans.registry import query, r4

# truth: the event's own type; prediction: the type of a neighbouring value
JUDGED = """
truth AS (SELECT user_id AS sample, event_id AS page, event_type AS truth_type FROM events),
pred AS (SELECT user_id AS sample, event_id AS page, CASE WHEN value < 2 THEN 'view' WHEN value < 6 THEN event_type ELSE 'click' END AS primary_type,
    CASE WHEN value < 10 THEN event_type ELSE 'error' END AS secondary_type FROM events WHERE event_id % 9 <> 0),
ambiguous AS (SELECT user_id AS sample, event_id AS page FROM events WHERE event_id % 13 = 0)"""
J = JUDGED.strip() + """,
judged AS (SELECT t.sample, t.page, t.truth_type, p.primary_type, p.secondary_type, coalesce(p.primary_type = t.truth_type, false) AS top1,
    coalesce(p.primary_type = t.truth_type, false) OR coalesce(p.secondary_type = t.truth_type, false) AS top2
  FROM truth t LEFT JOIN pred p USING (sample, page) WHERE NOT EXISTS (SELECT 1 FROM ambiguous a WHERE a.sample = t.sample AND a.page = t.page)),
counts AS (SELECT type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT truth_type AS type, top1::INT AS tp, 0 AS fp, (NOT top1)::INT AS fn FROM judged
    UNION ALL SELECT primary_type, 0, 1, 0 FROM judged WHERE NOT top1 AND primary_type IS NOT NULL) GROUP BY type),
scores AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM counts),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM scores)"""


def _part(t: Tables, name: str):
    return t.sql("WITH " + JUDGED + f" SELECT * FROM {name}")


def _judged(t: Tables):
    return evaluation.compare_pages(_part(t, "truth"), _part(t, "pred"), _part(t, "ambiguous"), ["sample", "page"])


@query("eval_pages", "", "WITH " + J + " SELECT sample, count(*) AS total, count(*) FILTER (WHERE top1) AS top1_correct, count(*) FILTER (WHERE top2) AS top2_correct FROM judged GROUP BY sample")
def eval_pages(t: Tables):
    return evaluation.page_accuracy(_judged(t), ["sample"])


@query("eval_types", "", "WITH " + J + f" SELECT type, tp, fp, fn, {R4('precision')} AS precision, {R4('recall')} AS recall, {R4('f1')} AS f1 FROM f")
def eval_types(t: Tables):
    scores = evaluation.per_type_scores(evaluation.per_type_counts(_judged(t)))
    return scores.select("type", "tp", "fp", "fn", *[r4(c).alias(c) for c in ("precision", "recall", "f1")])


@query("misclassified", "", "WITH " + J + " SELECT sample, page, truth_type, primary_type, secondary_type, top2 FROM judged WHERE NOT top1")
def misclassified(t: Tables):
    return evaluation.misclassified(_judged(t)).drop("top1")


@query(
    "quality_accuracy", "",
    "WITH " + J + f""", s AS (SELECT sample, count(*) FILTER (WHERE top1) / count(*) AS a FROM judged GROUP BY sample)
    SELECT CASE WHEN sample % 3 = 0 THEN 'scan' ELSE 'digital' END AS quality, {R4('avg(a)')} AS accuracy, count(*) AS samples FROM s GROUP BY 1""",
)
def quality_accuracy(t: Tables):
    judged = _judged(t)
    samples = _part(t, "truth").select("sample").distinct().withColumn(
        "quality", F.when(F.col("sample") % 3 == 0, F.lit("scan")).otherwise(F.lit("digital"))
    )
    return evaluation.quality_accuracy(judged, samples, ["sample"]).withColumn("accuracy", r4("accuracy"))


VALUES = """
vtruth AS (SELECT l_orderkey AS sample, l_partkey AS item, CASE l_linenumber WHEN 1 THEN 'site_area_sqm' WHEN 2 THEN 'building_area_sqm' WHEN 3 THEN 'floor_area_ratio_pct'
      WHEN 4 THEN 'floors_above' WHEN 5 THEN 'parking_count' ELSE 'other' END AS field, l_suppkey AS s,
    CASE WHEN l_returnflag = 'A' AND l_quantity < 5 THEN NULL ELSE l_quantity - 1 END AS truth, CASE WHEN l_tax > 0.06 THEN false ELSE true END AS present FROM lineitem),
vpred AS (SELECT l_orderkey AS sample, l_partkey AS item, CASE l_linenumber WHEN 1 THEN 'site_area_sqm' WHEN 2 THEN 'building_area_sqm' WHEN 3 THEN 'floor_area_ratio_pct'
      WHEN 4 THEN 'floors_above' WHEN 5 THEN 'parking_count' ELSE 'other' END AS field, l_suppkey AS s,
    CASE WHEN l_discount > 0.08 THEN NULL ELSE l_quantity - 1 + CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS DOUBLE) ELSE 0 END END AS pred FROM lineitem)"""
V = VALUES.strip() + """,
tol AS (SELECT * FROM (VALUES ('site_area_sqm', 10.0E0, 0.01E0), ('building_area_sqm', 5.0E0, 0.02E0), ('floor_area_ratio_pct', 0.5E0, 0.02E0), ('floors_above', 0.0E0, 0.0E0), ('parking_count', 2.0E0, 0.02E0), ('other', 0.0E0, 0.0E0)) AS x(field, a, r)),
e AS (SELECT t.*, p.pred, abs(p.pred - t.truth) AS ae, CASE WHEN t.truth <> 0 THEN abs(p.pred - t.truth) / abs(t.truth) WHEN p.pred = t.truth THEN 0 ELSE CAST('inf' AS DOUBLE) END AS re, tol.a, tol.r
  FROM vtruth t LEFT JOIN vpred p USING (sample, item, field, s) JOIN tol USING (field)),
v AS (SELECT *, CASE WHEN pred IS NOT NULL AND truth IS NOT NULL THEN ae <= a OR (r > 0 AND re <= r) END AS match FROM e)"""


def _values(t: Tables):
    truth = t.sql("WITH " + VALUES + " SELECT * FROM vtruth")
    pred = t.sql("WITH " + VALUES + " SELECT * FROM vpred")
    return evaluation.compare_values(truth, pred, ["sample", "item", "s"])


@query(
    "eval_values", "",
    "WITH " + V + """ SELECT sample, item, s, field, match, present AS gt_present, pred IS NOT NULL AS pred_present,
      present AND pred IS NOT NULL AS completion, NOT present AND pred IS NOT NULL AS fp, ae AS abs_err FROM v""",
)
def eval_values(t: Tables):
    return _values(t).drop("pred", "truth", "rel_err")


@query(
    "eval_fields", "",
    "WITH " + V + f""" SELECT field, {R4('count(*) FILTER (WHERE present AND pred IS NOT NULL) / nullif(count(*) FILTER (WHERE present), 0)')} AS completion,
      {R4('count(*) FILTER (WHERE match) / count(match)')} AS match_rate, count(*) FILTER (WHERE NOT present) AS absent,
      count(*) FILTER (WHERE NOT present AND pred IS NOT NULL) AS false_positives FROM v GROUP BY field""",
)
def eval_fields(t: Tables):
    out = evaluation.field_summary(_values(t))
    return out.select("field", r4("completion").alias("completion"), r4("match_rate").alias("match_rate"), "absent", "false_positives")


@query(
    "eval_summary", "",
    "WITH " + J + "," + V + f""" SELECT (SELECT count(*) FROM judged) AS pages, (SELECT {R4('count(*) FILTER (WHERE top1) / count(*)')} FROM judged) AS top1,
      (SELECT {R4('count(*) FILTER (WHERE top2) / count(*)')} FROM judged) AS top2,
      (SELECT {R4('count(*) FILTER (WHERE NOT top1 AND primary_type IS NOT NULL) / count(*)')} FROM judged) AS page_fp_rate,
      (SELECT {R4('avg(round_even(f1, 3))')} FROM f) AS macro_f1,
      (SELECT {R4('count(*) FILTER (WHERE present AND pred IS NOT NULL) / count(*) FILTER (WHERE present)')} FROM v) AS field_completion_rate,
      (SELECT {R4('count(*) FILTER (WHERE NOT present AND pred IS NOT NULL) / count(*) FILTER (WHERE NOT present)')} FROM v) AS field_fp_rate""",
)
def eval_summary(t: Tables):
    out = evaluation.overall(_judged(t), _values(t), ["sample"])
    return out.select("pages", *[r4(c).alias(c) for c in out.columns if c != "pages"])


@query(
    "eval_categories", "",
    f"""WITH p AS (SELECT p_partkey AS sample, p_name, p_type, p_size, p_size % 4 AS k FROM part)
    SELECT sample, CASE k WHEN 0 THEN 'structure_system' WHEN 1 THEN 'zoning' WHEN 2 THEN 'mass_type' ELSE 'certification' END AS field,
      CASE k WHEN 0 THEN p_size % 8 = 0 WHEN 1 THEN true WHEN 2 THEN p_size > 25 ELSE p_size % 8 = 3 END AS match,
      {R4('CASE k WHEN 0 THEN CASE WHEN p_size % 8 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN p_size > 25 THEN 1 ELSE 0 END ELSE CASE WHEN p_size % 8 = 3 THEN round_even(2 / 3, 3) ELSE 0.5E0 END END')} AS similarity
    FROM p""",
)
def eval_categories(t: Tables):
    rows = t.sql(
        """SELECT p_partkey AS sample, CASE p_size % 4 WHEN 0 THEN 'structure_system' WHEN 1 THEN 'zoning' WHEN 2 THEN 'mass_type' ELSE 'certification' END AS field,
           CASE p_size % 4 WHEN 0 THEN '철근콘크리트 구조' WHEN 1 THEN p_type || ' (' || p_name || ')' WHEN 2 THEN p_type ELSE 'x, ' || p_type END AS truth,
           CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 8 = 0 THEN 'rc조' ELSE '철 골' END WHEN 1 THEN lower(p_type) || p_name
             WHEN 2 THEN CASE WHEN p_size > 25 THEN p_type ELSE 'none' END ELSE CASE WHEN p_size % 8 = 3 THEN 'x/' || p_type || ' y' ELSE p_type END END AS pred FROM part"""
    )
    out = evaluation.compare_categories(rows.drop("pred"), rows.drop("truth"), ["sample"])
    return out.select("sample", "field", "match", r4("similarity").alias("similarity"))


AUDIT = """
items AS (SELECT o_custkey AS competition_id, l_suppkey % 3 AS company, '강점 ' || CASE WHEN l_linenumber < 3 THEN '(p.' || CAST(l_linenumber * 3 AS STRING) || ')' WHEN l_linenumber = 3 THEN '(p.2, 90)' WHEN l_linenumber = 4 THEN '(p.?)' ELSE '' END AS text, l_linenumber AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
gcells AS (SELECT o_custkey AS competition_id, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'A' END AS grade, CASE WHEN o_orderstatus = 'P' THEN 5.0E0 END AS score FROM orders),
comps AS (SELECT c_custkey AS competition_id, c_nationkey % 2 = 0 AS has_gap, CASE WHEN c_nationkey % 3 = 0 THEN 'v1' END AS rubric_version FROM customer),
totals AS (SELECT c_custkey AS competition_id, CAST(0 AS BIGINT) AS company, CAST(c_nationkey AS INT) AS total_pages FROM customer
  UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), CAST(c_nationkey AS INT) FROM customer)"""


@query(
    "drift_audit", "",
    "WITH " + AUDIT.strip() + f""",
    i AS (SELECT i.competition_id, count(*) AS items, count(*) FILTER (WHERE n <= 4) AS citations,
        sum(CASE WHEN coalesce(t.total_pages, 0) > 0 THEN CASE WHEN n < 3 THEN CASE WHEN n * 3 > t.total_pages THEN 1 ELSE 0 END WHEN n = 3 THEN CASE WHEN 2 > t.total_pages THEN 1 ELSE 0 END + CASE WHEN 90 > t.total_pages THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END) AS bad
      FROM items i LEFT JOIN totals t ON t.competition_id = i.competition_id AND t.company = i.company GROUP BY 1),
    f AS (SELECT competition_id, arg_max(CASE WHEN grade IS NOT NULL THEN 'grade' ELSE 'score' END, ord) FILTER (WHERE grade IS NOT NULL OR score IS NOT NULL) AS format FROM gcells GROUP BY 1)
    SELECT c.competition_id, coalesce(format, '?') AS format, coalesce(items, 0) AS items, coalesce(citations, 0) AS citations, coalesce(bad, 0) AS out_of_range,
      {R4('coalesce(100.0E0 * citations / items, 0)')} AS coverage_pct, coalesce(format = 'score', false) AS old_format, coalesce(100.0E0 * citations / items, 0) < 50 AS low_coverage,
      NOT has_gap AS no_gap_analysis, rubric_version IS NULL AS no_rubric_version
    FROM comps c LEFT JOIN f USING (competition_id) LEFT JOIN i USING (competition_id)""",
)
def drift_audit(t: Tables):
    part = lambda n: t.sql("WITH " + AUDIT + f" SELECT * FROM {n}")
    out = audit.comparison_drift(part("items"), part("gcells"), part("comps"), part("totals"), ["competition_id"])
    return out.withColumn("coverage_pct", r4("coverage_pct"))


@query(
    "routing_audit", "guideline_items",
    """p AS (SELECT DISTINCT doc_id, page FROM guideline_items),
    e AS (SELECT DISTINCT doc_id, page FROM guideline_items WHERE page <> 4),
    h AS (SELECT doc_id, count(*) AS hits, count(*) FILTER (WHERE NOT facility_scope IN ('구청R', '')) AS misrouted
      FROM guideline_items WHERE page <> 4 AND section_path LIKE '%끝' GROUP BY 1)
    SELECT p.doc_id, count(*) AS design_pages, count(e.page) AS with_groups, count(*) FILTER (WHERE p.page = 5) AS merged_pages,
      coalesce(any_value(h.hits), 0) AS hits, coalesce(any_value(h.misrouted), 0) AS misrouted
    FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND e.page = p.page LEFT JOIN h ON h.doc_id = p.doc_id GROUP BY p.doc_id""",
)
def routing_audit(t: Tables):
    items = t.view("guideline_items")
    pages = items.select("doc_id", "page").distinct().select(
        "doc_id", "page", F.lit("BRIEF_DESIGN_GUIDE").alias("primary_type"), (F.col("page") == 5).alias("merged")
    )
    entries = items.filter("page <> 4").select("doc_id", "page", "facility_scope", F.col("section_path").alias("path"))
    return audit.routing_audit(entries, pages, ["doc_id"], {"끝": "상세"}, ["구청R", ""])


# --- documents -----------------------------------------------------------------------


def _elements(t: Tables):
    """Lines of every document as paragraphs; a line in capitals stands for a heading, lines
    between pipes for tables."""
    lines = t.view("doc_lines")
    return lines.select(
        "doc_id", F.col("p").alias("ord"),
        F.when(F.col("line").startswith("|"), F.lit("table")).otherwise(F.lit("paragraph")).alias("kind"),
        F.col("line").alias("text"),
        (F.length("line") < 25).alias("is_heading"),
    )


BLOCKS = """
el AS (SELECT doc_id, p AS ord, trim(line) AS text, length(line) < 25 AS hd, line LIKE '|%' AS tb,
    regexp_matches(trim(line), '^(제\\d+장|\\d+(\\.\\d+){0,3})\\s|\\[\\s*(표|양식|서식|별표)\\s*\\d+') AS num,
    regexp_matches(line, '\\t\\d+\\s*$') AS toc FROM doc_lines),
nb AS (SELECT *, lag(tb) OVER w AS ptb, lag(toc) OVER w AS ptoc FROM el WHERE tb OR text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
seg AS (SELECT *, sum(CASE WHEN ptb IS NULL OR ptb OR ptoc <> (toc AND NOT tb) OR (NOT tb AND NOT toc AND (hd OR num)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY ord) AS segment FROM nb)"""


@query(
    "block_segments", "doc_lines",
    BLOCKS + " SELECT doc_id, segment, count(*) AS elements, min(ord) AS start FROM seg GROUP BY ALL",
)
def block_segments(t: Tables):
    return blocks.segments(_elements(t), ["doc_id"]).groupBy("doc_id", "segment").agg(
        F.count("*").alias("elements"), F.min("ord").alias("start")
    )


FLAT = BLOCKS.replace("(\\.\\d+){0,3}", "(\\.\\d+)*").replace("lag(toc) OVER w AS ptoc", "lag(toc) OVER w AS ptoc, lag(ord) OVER w AS pord").replace(
    "ptb IS NULL OR ptb OR", "ptb IS NULL OR ptb OR tb OR ord - pord > 3 OR"
)


def _blocks_sql(segments: str, orphan: str, own: str) -> str:
    """Blocks cut one after the other by recursion, then their headers."""
    return segments + f""",
pr AS (SELECT *, toc AND NOT tb AS tc, count(*) FILTER (WHERE NOT tb) OVER (PARTITION BY doc_id, segment ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(NOT tb AS INT) AS k,
    regexp_matches(text, '\\[\\s*(표|양식|서식|별표)\\s*\\d+') AS cap, regexp_matches(text, '^(그림\\s*\\d+|Fig\\.)') AS fig, regexp_matches(text, '\\(\\s*계속\\s*\\)') AS cont FROM seg),
sz AS (SELECT doc_id, segment, k + 1 AS p, length(text) AS size, sum(length(text)) OVER (PARTITION BY doc_id, segment ORDER BY k) AS c FROM pr WHERE NOT tb AND NOT tc),
lo AS (SELECT doc_id, segment FROM sz GROUP BY ALL HAVING count(*) >= 60 OR sum(size) >= 12000),
nx AS (SELECT a.doc_id, a.segment, a.p - 1 AS j, min(b.p) AS i FROM sz a JOIN lo USING (doc_id, segment)
    JOIN sz b ON a.doc_id = b.doc_id AND a.segment = b.segment AND b.p BETWEEN a.p AND a.p + 59
    WHERE (b.p - a.p >= 59 OR b.c - a.c + a.size >= 12000) AND NOT (a.p = 1 AND b.p = 1) GROUP BY ALL),
cutting AS (SELECT doc_id, segment, i AS b, 1 AS n FROM nx WHERE j = 0
    UNION ALL SELECT o.doc_id, o.segment, nx.i, n + 1 FROM cutting o JOIN nx ON nx.doc_id = o.doc_id AND nx.segment = o.segment AND nx.j = o.b),
ct AS (SELECT pr.*, coalesce(o.n, 0) AS cut FROM pr ASOF LEFT JOIN cutting o ON o.doc_id = pr.doc_id AND o.segment = pr.segment AND pr.k >= o.b),
raw AS (SELECT doc_id, segment, cut, min(ord) AS start, count(*) FILTER (WHERE NOT tb) AS paragraphs, coalesce(sum(length(text)) FILTER (WHERE NOT tb), 0) AS chars,
    bool_or(tb) AS has_table, bool_or(tc) AS is_toc, bool_or(NOT tb AND (hd OR num)) AS headed,
    arg_min(text, ord) FILTER (WHERE NOT tb AND hd AND NOT (fig OR cont)) AS heading, arg_min(text, ord) FILTER (WHERE NOT tb AND cap) AS caption,
    arg_min(text, ord) FILTER (WHERE tb AND text <> '') AS tab, arg_min(text, ord) FILTER (WHERE NOT tb AND NOT (fig OR cont)) AS plain,
    arg_min(text, ord) FILTER (WHERE NOT tb) AS only_, arg_min(text, ord) FILTER (WHERE NOT tb AND num) AS numbered FROM ct GROUP BY doc_id, segment, cut),
nu AS (SELECT *, {orphan} AS orphan, sum(CASE WHEN {orphan} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS block_num FROM raw),
cr AS (SELECT doc_id, block_num + 1 AS block_num, list(only_ ORDER BY start) AS trail FROM nu WHERE orphan GROUP BY ALL),
bl AS (SELECT * FROM (SELECT * FROM nu WHERE NOT orphan) FULL JOIN cr USING (doc_id, block_num)),
hd AS (SELECT *, CASE WHEN is_toc THEN '(목차)' ELSE coalesce({own}, '(블록 ' || block_num || ')') END AS own FROM bl)
SELECT doc_id, block_num, array_to_string(list_concat(coalesce(trail, []), CASE WHEN start IS NULL THEN [] ELSE [own] END), ' > ') || CASE WHEN cut > 0 THEN ' (계속)' ELSE '' END AS header_text,
    coalesce(paragraphs, 0) AS paragraphs, coalesce(chars, 0) AS chars, coalesce(has_table, FALSE) AS has_table, coalesce(is_toc, FALSE) AS is_toc, segment, cut FROM hd"""


@query(
    "document_blocks", "doc_lines",
    _blocks_sql(BLOCKS, "(paragraphs = 1 AND NOT has_table AND NOT is_toc AND headed)", "heading, caption, tab, plain"),
)
def document_blocks(t: Tables):
    return blocks.document_blocks(_elements(t), ["doc_id"])


@query(
    "flat_blocks", "doc_lines",
    _blocks_sql(FLAT, "FALSE", "numbered, CASE WHEN length(only_) < 60 AND NOT regexp_matches(only_, '^(그림\\s*\\d+|Fig\\.)') THEN only_ END, tab, plain"),
)
def flat_blocks(t: Tables):
    return blocks.document_blocks(_elements(t), ["doc_id"], tables_alone=True)


@query(
    "block_source_text", "",
    """WITH s AS (SELECT doc_id, '[HEADER] ' || source || chr(10) || chr(10) || '[PARAGRAPHS]' || chr(10) || chr(10) || text AS w FROM documents)
    SELECT doc_id, md5(CASE WHEN length(w) <= 6000 THEN w ELSE left(w, 4000) || chr(10) || chr(10) || '[...생략...]' || chr(10) || chr(10) || right(w, 2000) END) AS digest FROM s""",
)
def block_source_text(t: Tables):
    docs = t.table("documents").withColumn("paragraphs", F.array("text")).withColumn("tab", F.lit(""))
    text = blocks.source_text("source", "paragraphs", "tab", ends=(fixed.SOURCE_HEAD, fixed.SOURCE_TAIL))
    return docs.select("doc_id", F.md5(text).alias("digest"))


# a table per order as HTML: one row per line, the first cell spans two rows or two columns
HTML = """
tr AS (SELECT l_orderkey AS doc_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r,
    COUNT(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag, l_linestatus, l_linenumber FROM lineitem)"""


@query(
    "cell_grid", "",
    "WITH " + HTML.strip() + """,
    g AS (SELECT doc_id, r - 1 AS row, n, l_returnflag AS a, l_linestatus || '&' || l_linenumber AS b, (r = 1 AND n > 1) AS spans, (r = 2) AS under FROM tr)
    SELECT doc_id, row, 0 AS col, CASE WHEN under THEN '' ELSE a END AS text, CASE WHEN spans THEN 2 ELSE 1 END AS rowspan FROM g
    UNION ALL SELECT doc_id, row, 1, b, 1 FROM g UNION ALL SELECT doc_id, row, 2, b, 1 FROM g""",
)
def cell_grid(t: Tables):
    rows = t.sql("WITH " + HTML + " SELECT * FROM tr")
    first = F.when(
        F.col("r") == 2, F.lit("")
    ).otherwise(F.concat(F.when((F.col("r") == 1) & (F.col("n") > 1), F.lit('<td rowspan="2">')).otherwise(F.lit("<TD>")), "l_returnflag", F.lit("</td>")))
    html = rows.withColumn(
        "tr", F.concat(F.lit("<tr>"), first, F.lit("<th colspan=2><b>"), "l_linestatus", F.lit("&amp;"), "l_linenumber", F.lit("</b></th></tr>"))
    ).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tr"))), lambda x: x.tr), "").alias("b")
    ).select("doc_id", F.concat(F.lit("<p>x</p><table border=1>"), "b", F.lit("</table>")).alias("html"))
    grid = blocks.cell_grid(blocks.html_cells(html, ["doc_id"]), ["doc_id", "table_no"])
    return grid.drop("table_no")


@query(
    "grid_lines", "",
    "WITH " + HTML.strip() + " SELECT doc_id, CAST(r - 1 AS INT) AS row, l_returnflag || ' | ' || l_linestatus AS line FROM tr",
)
def grid_lines(t: Tables):
    rows = t.sql("WITH " + HTML + " SELECT doc_id, CAST(r - 1 AS INT) AS row, l_returnflag, l_linestatus FROM tr")
    cells = rows.select("doc_id", "row", F.lit(0).alias("col"), F.col("l_returnflag").alias("text")).unionByName(
        rows.select("doc_id", "row", F.lit(1).alias("col"), F.col("l_linestatus").alias("text"))
    )
    return blocks.grid_lines(cells, ["doc_id"])
