"""Queries on requirement matching, citations, numbers and prose."""

from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import prose, similar
from dossierlake.plans.adapters import Tables
from dossierlake.plans.adapters import r4 as R4
from dossierlake.plans.registry import query, r4

NOISE = r"[\s·、,，.。\-–—/()\[\]{}「」『』\"'':;!?~%]+"


def _grams(c: str) -> str:
    return (
        f"CASE WHEN length({c}) < 2 THEN [{c}] ELSE list_distinct([substr({c}, CAST(i AS INT), 2) "
        f"for i in range(1, length({c}))]) END"
    )


MATCHES = f"""
r0 AS (SELECT doc_id, idx, axis, lower(regexp_replace(description, '{NOISE}', '', 'g')) AS norm FROM reqs WHERE trim(description) <> ''),
m0 AS (SELECT doc_id, idx, axis, lower(regexp_replace(requirement, '{NOISE}', '', 'g')) AS norm FROM maps WHERE trim(requirement) <> ''),
rt AS (SELECT doc_id, idx, axis, {_grams('norm')} AS g FROM r0 WHERE norm <> ''),
mt AS (SELECT doc_id, idx, axis, {_grams('norm')} AS g FROM m0 WHERE norm <> ''),
re AS (SELECT doc_id, idx, unnest(g) AS t FROM rt), me AS (SELECT doc_id, idx, unnest(g) AS t FROM mt),
common AS (SELECT r.doc_id, r.idx AS ri, m.idx AS mi, count(*) AS n FROM re r JOIN me m ON r.doc_id = m.doc_id AND r.t = m.t GROUP BY ALL),
scored AS (SELECT c.*, n / least(len(r.g), len(m.g)) AS score, r.axis = m.axis AND r.axis <> '' AS same
  FROM common c JOIN rt r ON r.doc_id = c.doc_id AND r.idx = c.ri JOIN mt m ON m.doc_id = c.doc_id AND m.idx = c.mi),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ri ORDER BY score DESC, mi) AS k FROM scored
  WHERE score >= CASE WHEN same THEN 0.3E0 ELSE 0.5E0 END) WHERE k = 1),
matches AS (SELECT r.doc_id, r.idx, r.axis, b.score, b.mi AS map_idx FROM r0 r LEFT JOIN best b ON b.doc_id = r.doc_id AND b.ri = r.idx)"""


@query("requirement_matches", "reqs maps", MATCHES + f" SELECT doc_id, idx, axis, {R4('score')} AS score, map_idx FROM matches")
def requirement_matches(t: Tables):
    out = similar.requirement_matches(t.view("reqs"), t.view("maps"), ["doc_id"])
    return out.withColumn("score", r4("score"))


@query(
    "requirement_coverage", "reqs maps",
    MATCHES + """, a AS (SELECT doc_id, count(*) AS total, count(map_idx) AS mapped FROM matches GROUP BY 1),
    s AS (SELECT doc_id, count(*) FILTER (WHERE status = 'yes') AS n_yes, count(*) FILTER (WHERE status = 'partial') AS n_partial,
      count(*) FILTER (WHERE status = 'no') AS n_no, count(*) FILTER (WHERE status NOT IN ('yes', 'partial', 'no')) AS n_unclear FROM maps GROUP BY 1)
    SELECT coalesce(a.doc_id, s.doc_id) AS doc_id, coalesce(total, 0) AS total, coalesce(mapped, 0) AS mapped, coalesce(n_yes, 0) AS n_yes,
      coalesce(n_partial, 0) AS n_partial, coalesce(n_no, 0) AS n_no, coalesce(n_unclear, 0) AS n_unclear,
      CAST(round_even(100.0E0 * mapped / nullif(total, 0), 0) AS INT) AS coverage_pct
    FROM a FULL JOIN s ON a.doc_id = s.doc_id""",
)
def requirement_coverage(t: Tables):
    maps = t.view("maps")
    return similar.coverage_summary(similar.requirement_matches(t.view("reqs"), maps, ["doc_id"]), maps, ["doc_id"])


@query(
    "unanchored_answers", "reqs maps",
    MATCHES + """ SELECT doc_id, idx, requirement FROM maps m WHERE trim(requirement) <> ''
      AND NOT EXISTS (SELECT 1 FROM matches x WHERE x.doc_id = m.doc_id AND x.map_idx = m.idx)""",
)
def unanchored_answers(t: Tables):
    maps = t.view("maps")
    matches = similar.requirement_matches(t.view("reqs"), maps, ["doc_id"])
    return similar.unanchored(matches, maps, ["doc_id"]).select("doc_id", "idx", "requirement")


@query(
    "duplicate_sets", "doc_lines",
    f"""w AS (SELECT source, lang, idx, list_sort(list_distinct([x for x in regexp_split_to_array(trim(lower(line)), '\\s+') if x <> ''])) AS tk FROM doc_lines),
    s AS (SELECT source, lang, tk, min(idx) AS id, count(*) AS members FROM w WHERE len(tk) > 0 GROUP BY ALL),
    e AS (SELECT source, lang, id, len(tk) AS n, members, unnest(tk) AS t FROM s),
    c AS (SELECT a.source, a.lang, a.id AS a_id, b.id AS b_id, any_value(a.n) AS an, any_value(b.n) AS bn, any_value(a.members) AS am, any_value(b.members) AS bm, count(*) AS k
      FROM e a JOIN e b ON a.source = b.source AND a.lang = b.lang AND a.t = b.t AND a.id < b.id GROUP BY a.source, a.lang, a.id, b.id)
    SELECT source, lang, a_id, b_id, {R4('k / (an + bn - k)')} AS similarity, am * bm AS pairs FROM c WHERE k / (an + bn - k) >= 0.6E0
    UNION ALL SELECT source, lang, id, id, 1.0E0, members * (members - 1) // 2 FROM s WHERE members > 1""",
)
def duplicate_sets(t: Tables):
    lines = t.view("doc_lines").select("source", "lang", "idx", F.col("line").alias("description"))
    return similar.duplicate_sets(lines, ["source", "lang"]).withColumn("similarity", r4("similarity"))


@query(
    "duplicate_classes", "doc_lines",
    """w AS (SELECT source, lang, idx, list_sort(list_distinct([x for x in regexp_split_to_array(trim(lower(line)), '\\s+') if x <> ''])) AS tk FROM doc_lines),
    s AS MATERIALIZED (SELECT source, lang, tk, min(idx) AS id, count(*) AS members FROM w WHERE len(tk) > 0 GROUP BY ALL),
    e AS (SELECT source, lang, id, len(tk) AS n, unnest(tk) AS t FROM s),
    c AS (SELECT a.source, a.lang, a.id AS a_id, b.id AS b_id, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k
      FROM e a JOIN e b ON a.source = b.source AND a.lang = b.lang AND a.t = b.t AND a.id <> b.id GROUP BY a.source, a.lang, a.id, b.id),
    l AS MATERIALIZED (SELECT source, lang, a_id, b_id FROM c WHERE k / (an + bn - k) >= 0.6E0),
    reach AS (SELECT source, lang, a_id AS id, a_id AS other FROM l UNION SELECT r.source, r.lang, r.id, l.b_id FROM reach r JOIN l ON r.source = l.source AND r.lang = l.lang AND r.other = l.a_id),
    classes AS (SELECT source, lang, id, min(other) AS class_id FROM reach GROUP BY ALL),
    met AS (SELECT l.source, l.lang, l.a_id AS id, sum(s.members) AS met FROM l JOIN s ON s.source = l.source AND s.lang = l.lang AND s.id = l.b_id GROUP BY ALL)
    SELECT w.source, w.lang, w.idx, coalesce(c.class_id, s.id) AS class_id, s.members AS copies, CAST(coalesce(m.met, 0) + s.members - 1 AS BIGINT) AS links
    FROM w JOIN s ON w.source = s.source AND w.lang = s.lang AND w.tk = s.tk
      LEFT JOIN classes c ON c.source = s.source AND c.lang = s.lang AND c.id = s.id LEFT JOIN met m ON m.source = s.source AND m.lang = s.lang AND m.id = s.id""",
)
def duplicate_classes(t: Tables):
    lines = t.view("doc_lines").select("source", "lang", "idx", F.col("line").alias("description"))
    return similar.duplicate_classes(lines, ["source", "lang"])


RUNS = """
items AS (SELECT conv_id AS doc_id, 'turn' AS field, CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS run, text AS item FROM conversations WHERE role <> 'system'
  UNION ALL SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END,
    event_type || ' ' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) || ' ' || CAST(event_id % 50 AS STRING) FROM events)"""


@query(
    "run_difference", "",
    "WITH " + RUNS.strip() + r""",
    d AS (SELECT DISTINCT doc_id, field, run, item FROM items WHERE trim(item) <> ''),
    p AS (SELECT *, lower(regexp_replace(item, '[\s·,.\-()\[\]''"]+', '', 'g')) AS norm,
        [lower(x) for x in regexp_split_to_array(item, '[\s·,./()\[\]''"~:;|]+') if length(x) >= 2] AS words FROM d),
    pairs AS (SELECT a.doc_id, a.field, a.item AS ai, b.item AS bi,
        (a.norm <> '' AND b.norm <> '' AND (contains(b.norm, a.norm) OR contains(a.norm, b.norm))) AS inside,
        a.words AS aw, b.words AS bw
      FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND a.run = 'a' AND b.run = 'b'),
    met AS (SELECT *, len([x for x in aw if len([y for y in bw if contains(y, x) OR contains(x, y)]) > 0]) AS a_met,
        len([x for x in bw if len([y for y in aw if contains(y, x) OR contains(x, y)]) > 0]) AS b_met, len(aw) > 0 AND len(bw) > 0 AS told FROM pairs),
    sim AS (SELECT doc_id, field, ai, bi, inside OR (told AND CASE WHEN len(aw) <= len(bw) THEN 2 * a_met >= len(aw) ELSE 2 * b_met >= len(bw) END) AS for_a,
        inside OR (told AND CASE WHEN len(bw) <= len(aw) THEN 2 * b_met >= len(bw) ELSE 2 * a_met >= len(aw) END) AS for_b FROM met)
    SELECT doc_id, field, run, item FROM d WHERE NOT EXISTS (SELECT 1 FROM sim WHERE sim.doc_id = d.doc_id AND sim.field = d.field
      AND CASE WHEN d.run = 'a' THEN for_a AND sim.ai = d.item ELSE for_b AND sim.bi = d.item END)""",
)
def run_difference(t: Tables):
    items = t.sql("WITH " + RUNS + " SELECT * FROM items")
    return similar.run_difference(items, ["doc_id", "field"])


@query(
    "run_volume", "",
    "WITH " + RUNS.strip() + " SELECT doc_id, field, run, count(*) AS items, sum(length(item)) AS chars FROM items GROUP BY ALL",
)
def run_volume(t: Tables):
    return similar.run_volume(t.sql("WITH " + RUNS + " SELECT * FROM items"), ["doc_id", "field"])


CITED = """
cited AS (SELECT l_orderkey AS doc_id, l_suppkey % 4 AS company, l_partkey AS place,
    '당선작은 동선이 명확 (p.' || CAST(l_linenumber AS STRING) || ')과 (p. ' || CAST(CAST(l_quantity AS BIGINT) % 9 AS STRING) || ', ' || CAST(l_suppkey % 12 AS STRING) || ') 및 (p.?)' AS text,
    l_linenumber AS a, CAST(l_quantity AS BIGINT) % 9 AS b, l_suppkey % 12 AS c FROM lineitem),
bounds AS (SELECT l_orderkey AS doc_id, l_suppkey % 4 AS company, CASE WHEN COUNT(*) = 1 THEN NULL ELSE MAX(l_linenumber) END AS bound
    FROM lineitem WHERE l_suppkey % 4 <> 3 GROUP BY l_orderkey, l_suppkey % 4)"""


@query(
    "citation_bounds", "",
    "WITH " + CITED.strip() + """,
    n AS (SELECT doc_id, company, place, unnest([a, b, c]) AS cited_page FROM cited),
    u AS (SELECT doc_id, max(bound) AS bound FROM bounds GROUP BY doc_id)
    SELECT n.doc_id, n.company, n.place, n.cited_page, CASE WHEN k.doc_id IS NOT NULL THEN k.bound ELSE u.bound END AS bound
    FROM n LEFT JOIN bounds k ON k.doc_id = n.doc_id AND k.company = n.company LEFT JOIN u ON u.doc_id = n.doc_id
    WHERE CASE WHEN k.doc_id IS NOT NULL THEN k.bound ELSE u.bound END IS NOT NULL
      AND n.cited_page NOT BETWEEN 1 AND CASE WHEN k.doc_id IS NOT NULL THEN k.bound ELSE u.bound END""",
)
def citation_bounds(t: Tables):
    text = t.sql("WITH " + CITED + " SELECT doc_id, company, place, text FROM cited")
    bounds = t.sql("WITH " + CITED + " SELECT * FROM bounds")
    flags = prose.citation_flags(text, bounds, ["doc_id", "company"], ["doc_id"], ["place"])
    return flags.select("doc_id", "company", "place", "cited_page", "bound")


@query(
    "page_bounds", "cls",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN max(page) + 5 ELSE max(page) END AS bound FROM (
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE page END AS page FROM cls) GROUP BY doc_id""",
)
def page_bounds(t: Tables):
    cls = t.view("cls").select("doc_id", "page")
    docs = cls.groupBy("doc_id").agg((F.max("page") + 5).alias("n")).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("n")).when(F.col("doc_id") % 3 == 2, F.lit(0)).alias("total_pages")
    )
    return prose.page_bounds(docs, cls.filter("doc_id % 3 <> 0"), ["doc_id"])


# prose of labelled documents against the text of the others of the same source, and
# generated statements with risky units against the order's own figures
NUMBERS = """
prose AS (SELECT d.source AS doc, CAST(d.doc_id AS STRING) AS field, d.text FROM documents d JOIN labels b ON b.doc_id = d.doc_id
  UNION ALL SELECT 'o' || CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
    '총 ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '세대, 1,' || CAST(l_suppkey % 900 + 100 AS STRING) || '만원 규모이며 공실률 ' ||
    CAST(l_linenumber AS STRING) || '.50% 와 ' || CAST(l_partkey AS STRING) || ' 단위' FROM lineitem),
corpus AS (SELECT d.source AS doc, d.text FROM documents d LEFT JOIN labels b ON b.doc_id = d.doc_id WHERE b.doc_id IS NULL
  UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING) || '세대 20 세대 25세대 30세대 1.5% 2.50 % 7 % ' ||
    CAST(o_custkey AS STRING) || '만원 1,200만원' FROM orders)"""

_PLAIN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, ',', ''), '^0+(\\d)', '\\1'), "
    "'(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^$', '')"
)


@query(
    "number_grounding", "",
    "WITH " + NUMBERS.strip() + r""",
    toks AS (SELECT 'p' AS side, doc, field, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?\s*(?:만원|억|원|%|세대|가구|호)?')) AS tok FROM prose
      UNION ALL SELECT 'c', doc, '', unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?\s*(?:만원|억|원|%|세대|가구|호)?')) FROM corpus),
    split AS (SELECT side, doc, field, regexp_extract(tok, '^(\d[\d,]*(?:\.\d+)?)', 1) AS value, regexp_extract(tok, '(만원|억|원|%|세대|가구|호)$', 1) AS unit FROM toks),
    n AS (SELECT *, """ + _PLAIN.format("value") + r""" AS norm FROM split),
    known AS (SELECT DISTINCT doc, norm, unit FROM n WHERE side = 'c' UNION SELECT DISTINCT doc, norm, '' FROM n WHERE side = 'c')
    SELECT doc, field, norm, unit FROM (SELECT DISTINCT doc, field, norm, unit FROM n WHERE side = 'p'
      AND (unit <> '' OR length(regexp_replace(value, '\D', '', 'g')) >= 2)) p
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc = p.doc AND k.norm = p.norm AND k.unit = p.unit)""",
)
def number_grounding(t: Tables):
    text = t.sql("WITH " + NUMBERS + " SELECT * FROM prose")
    corpus = t.sql("WITH " + NUMBERS + " SELECT * FROM corpus")
    return prose.ungrounded_numbers(text, corpus, ["doc"]).select("doc", "field", "norm", "unit")


@query(
    "unanchored_claims", "",
    r"""WITH i AS (SELECT doc_id, regexp_extract(text, '(\d[\d,]*\d(?:\.\d+)?|\d\.\d+|\d[\d,]*(?:\.\d+)?\s*(?:만원|억|원|%|세대|가구|호))', 1) AS hit
      FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, rtrim(regexp_extract(hit, '^(\d[\d,]*(?:\.\d+)?)', 1), ',') AS value FROM i WHERE hit <> ''""",
)
def unanchored_claims(t: Tables):
    items = t.sql(
        """SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN array('p.1') WHEN doc_id % 3 = 1 THEN array(' ')
           ELSE cast(array() AS array<string>) END AS basis FROM documents"""
    )
    return prose.unanchored_claims(items, ["doc_id"]).select("doc_id", F.rtrim("value", F.lit(",")).alias("value"))


@query(
    "emphasis_sentences", "guideline_items",
    """f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY entry, page, item) AS r FROM guideline_items WHERE regexp_matches(text, '특히|반드시|우선'))
    SELECT doc_id, text, '반드시' AS marker, category FROM f WHERE r = 1""",
)
def emphasis_sentences(t: Tables):
    items = t.view("guideline_items").withColumn("ord", F.struct("entry", "page", "item"))
    return prose.emphasis_sentences(items, ["doc_id"]).select("doc_id", "text", "marker", "category")


@query(
    "category_weights", "guideline_items",
    """SELECT doc_id, coalesce(nullif(trim(category), ''), '(미분류)') AS category, count(*) AS item_count, count(DISTINCT nullif(trim(section_path), '')) AS sections
       FROM guideline_items GROUP BY ALL""",
)
def category_weights(t: Tables):
    items = t.view("guideline_items").withColumnRenamed("section_path", "section")
    return prose.category_weights(items, ["doc_id"])


@query(
    "placement_sentences", "statements",
    """f AS (SELECT doc_id, trim(text) AS text, min(ord) AS place FROM statements WHERE length(trim(text)) >= 6
        AND regexp_matches(text, '층|지하|지상|배치|위치|인접|남측') GROUP BY ALL)
    SELECT doc_id, text, place, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank FROM f)""",
)
def placement_sentences(t: Tables):
    return prose.placement_sentences(t.view("statements"), ["doc_id"])


@query(
    "differentiator_parts", "",
    """SELECT l_orderkey, l_partkey, l_linenumber,
       CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_returnflag = 'A' THEN '컨셉' ELSE l_returnflag END AS axis,
       CASE WHEN l_linenumber % 3 = 0 THEN '당선작은 X전략: ' || l_partkey ELSE '당선작은 ' || l_partkey || ' - 강점' END AS body,
       CASE WHEN l_linestatus = 'F' THEN '낙선작은 ' || l_suppkey ELSE '' END AS insight FROM lineitem""",
)
def differentiator_parts(t: Tables):
    lines = t.sql(
        """SELECT l_orderkey, l_partkey, l_linenumber,
           CASE WHEN l_linenumber % 3 = 0 THEN '당선작은 X전략' ELSE CASE WHEN l_returnflag = 'A' THEN 'concept' ELSE l_returnflag END END || ': ' ||
           CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '당선작은 ' END || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' - 강점' END ||
           CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber % 2 = 0 THEN ' — ' ELSE '–' END || '낙선작은 ' || l_suppkey ELSE '' END AS text FROM lineitem"""
    )
    out = prose.differentiator_parts(lines, {"concept": "컨셉"})
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "axis", "body", "insight")


@query(
    "grade_tails", "",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '동선이 명확' || event_id WHEN 1 THEN '배치 우수(p.3)'
       WHEN 2 THEN 'B 수준(p.2)에 그치나 개선됨 ' || event_id ELSE '조경 양호' END AS notes FROM events""",
)
def grade_tails(t: Tables):
    notes = t.sql(
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '동선이 명확' || event_id || '되어 B 수준' WHEN 1 THEN '배치 우수 A~B 수준(p.3)'
           WHEN 2 THEN 'B 수준(p.2)에 그치나 개선됨 ' || event_id ELSE '조경 양호으로 C 수준 ' END AS n FROM events"""
    )
    return notes.select("event_id", T.strip_grade_tail("n").alias("notes"))
