"""Queries on comparisons of submissions and on search."""

import uuid

from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions import labels
from dossierlake.operators import comparison, patterns, scan, search
from dossierlake.plans.adapters import Tables
from dossierlake.plans.adapters import r4 as R4
from dossierlake.plans.registry import query, r4
from dossierlake.sources import files, search_index


@query(
    "blind_labels", "subs",
    """SELECT competition_id, company, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) || '안' ELSE '안' || n END AS label FROM (
       SELECT competition_id, company, row_number() OVER (PARTITION BY competition_id ORDER BY company) AS n FROM subs)""",
)
def blind_labels(t: Tables):
    out = comparison.blind_labels(t.view("subs"), ["competition_id"], "company")
    return out.select("competition_id", "company", "label")


@query(
    "restored_names", "subs",
    """SELECT competition_id, company AS company, label FROM (SELECT competition_id, company, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) || '안' ELSE '안' || n END AS label, n FROM (
       SELECT competition_id, company, row_number() OVER (PARTITION BY competition_id ORDER BY company) AS n FROM subs))
       UNION ALL SELECT DISTINCT competition_id, NULL, '미정안' FROM subs""",
)
def restored_names(t: Tables):
    labelled = comparison.blind_labels(t.view("subs"), ["competition_id"], "company")
    cells = labelled.select("competition_id", "label").unionByName(
        labelled.select("competition_id", F.lit("미정안").alias("label")).distinct()
    )
    names = labelled.withColumn("company", F.col("company").cast("string"))
    out = comparison.restore_names(cells, names, ["competition_id"])
    return out.select("competition_id", F.col("company").try_cast("bigint").alias("company"), "label")


@query(
    "gap_analysis", "subs",
    """r AS (SELECT competition_id, company, result, row_number() OVER (PARTITION BY competition_id ORDER BY price DESC, company) AS pos,
        count(*) OVER (PARTITION BY competition_id) AS n FROM subs),
    g AS (SELECT competition_id, any_value(n) AS ranked, arg_min(company, pos) AS blind_top1, count(*) FILTER (WHERE result <> 'lose') AS winners,
        count(*) FILTER (WHERE result <> 'lose' AND pos <= greatest(1, (n + 1) // 2)) AS top, bool_or(result <> 'lose' AND pos = 1) AS m FROM r GROUP BY 1)
    SELECT competition_id, blind_top1, ranked, winners, m AS top1_matches_winner, CASE WHEN winners = 0 THEN 'unknown' WHEN m AND top / winners >= 0.9E0 THEN 'high'
      WHEN top / winners >= 0.5E0 THEN 'partial' ELSE 'low' END AS alignment FROM g""",
)
def gap_analysis(t: Tables):
    subs = t.view("subs")
    ranking = scan.positions(
        subs.select("competition_id", "company", "price"), ["competition_id"], "price", "company", descending=True
    )
    return comparison.gap_analysis(ranking, subs, ["competition_id"])


PLANS = """
plans AS (SELECT s.competition_id, s.company, (l.l_partkey * 100000 + l.l_suppkey) * 10 + l.l_linenumber AS ord,
    CASE l.l_linenumber WHEN 1 THEN 'b' || CAST(l.l_suppkey % 4 + 1 AS STRING) WHEN 2 THEN CAST(l.l_suppkey % 30 AS STRING) || ' f' WHEN 3 THEN '옥상'
      WHEN 4 THEN '지하 ' || CAST(l.l_suppkey % 3 + 1 AS STRING) WHEN 5 THEN '지상 ' || CAST(l.l_suppkey % 5 + 1 AS STRING) ELSE '미상' END AS floor_level,
    CASE l.l_returnflag WHEN 'A' THEN ' 주차장' WHEN 'N' THEN '주민 도서관' ELSE CASE WHEN l.l_linestatus = 'F' THEN 'unit plan' ELSE '회의실' END END AS programme
  FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id)"""


@query(
    "floor_matrix", "subs",
    PLANS.strip() + """,
    f AS (SELECT *, trim(programme) AS p, CASE WHEN floor_level = '옥상' THEN 10000 WHEN floor_level LIKE 'b%' OR floor_level LIKE '지하%' THEN -CAST(regexp_extract(floor_level, '(\\d+)', 1) AS INT)
        WHEN regexp_matches(floor_level, '\\d') THEN CAST(regexp_extract(floor_level, '(\\d+)', 1) AS INT) END AS o FROM plans),
    v AS (SELECT * FROM f WHERE o IS NOT NULL AND o <> 0),
    c AS (SELECT competition_id, company, o AS floor_order, count(DISTINCT p) AS programmes, arg_min(p, ord) AS first_programme FROM v GROUP BY ALL)
    SELECT competition_id, company, floor_order, programmes, first_programme, CASE first_programme WHEN '주차장' THEN 'core' WHEN '주민 도서관' THEN 'culture' WHEN 'unit plan' THEN 'residence' ELSE 'office' END AS category,
      CASE WHEN floor_order = 10000 THEN 'ROOF' WHEN floor_order < 0 THEN 'B' || -floor_order ELSE floor_order || 'F' END AS floor FROM c""",
)
def floor_matrix(t: Tables):
    plans = t.sql(PLANS.strip()[len("plans AS ("):-1], "subs")
    return comparison.floor_cells(plans, ["competition_id"])


@query(
    "floor_matrix_pivot", "subs",
    PLANS.strip() + """,
    f AS (SELECT * EXCLUDE (company), company % 4 AS company, trim(programme) AS p, CASE WHEN floor_level = '옥상' THEN 10000 WHEN floor_level LIKE 'b%' OR floor_level LIKE '지하%' THEN -CAST(regexp_extract(floor_level, '(\\d+)', 1) AS INT)
        WHEN regexp_matches(floor_level, '\\d') THEN CAST(regexp_extract(floor_level, '(\\d+)', 1) AS INT) END AS o FROM plans),
    c AS (SELECT competition_id, company, o AS floor_order, CASE arg_min(p, ord) WHEN '주차장' THEN 'core' WHEN '주민 도서관' THEN 'culture' WHEN 'unit plan' THEN 'residence' ELSE 'office' END AS category
      FROM f WHERE o IS NOT NULL AND o <> 0 GROUP BY ALL)
    SELECT competition_id, floor_order, CASE WHEN floor_order = 10000 THEN 'ROOF' WHEN floor_order < 0 THEN 'B' || -floor_order ELSE floor_order || 'F' END AS floor,
      max(category) FILTER (company = 0) AS "0", max(category) FILTER (company = 1) AS "1", max(category) FILTER (company = 2) AS "2", max(category) FILTER (company = 3) AS "3" FROM c GROUP BY competition_id, floor_order""",
)
def floor_matrix_pivot(t: Tables):
    """The matrix itself; its columns are the companies found."""
    plans = t.sql(PLANS.strip()[len("plans AS ("):-1], "subs").withColumn("company", F.col("company") % 4)
    return comparison.floor_matrix(comparison.floor_cells(plans, ["competition_id"]), ["competition_id"])


@query(
    "grade_resolve", "",
    """SELECT event_id, g AS grade, CASE WHEN g IN ('A', 'B') THEN '우수' WHEN g = 'C' THEN '보통' WHEN g IN ('D', 'E') THEN '미흡' ELSE '' END AS label FROM (
      SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE
        CASE WHEN value >= 8.5E0 THEN 'A' WHEN value >= 7 THEN 'B' WHEN value >= 5 THEN 'C' WHEN value >= 3 THEN 'D' ELSE 'E' END END AS g FROM events)""",
)
def grade_resolve(t: Tables):
    rows = t.sql("SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN '상' WHEN 2 THEN '중' WHEN 3 THEN '' WHEN 4 THEN 'X' END AS g FROM events")
    graded = rows.withColumn("grade", labels.resolve_grade("g", "value"))
    return graded.select("event_id", "grade", labels.grade_label("grade").alias("label"))


@query(
    "card_filter", "subs",
    """SELECT facility_type, competition_id, count(*) AS submissions, count(*) FILTER (WHERE result <> 'lose') AS winners FROM subs
       WHERE facility_type = 'public' GROUP BY ALL HAVING count(*) FILTER (WHERE result <> 'lose') > 0""",
)
def card_filter(t: Tables):
    return comparison.card_filter(patterns.project_rollup(t.view("subs")), "public", "win")


# requests: every customer of a nation picks a price band of orders, several customers share one
CHOSEN = """
chosen AS (SELECT s.competition_id % 50 AS request, s.facility_type, s.competition_id, s.priority AS company FROM subs s),
named AS (SELECT DISTINCT facility_type, competition_id, priority AS company FROM subs),
projects AS (SELECT DISTINCT facility_type, competition_id, 'P' || CAST(competition_id AS STRING) AS competition_name FROM subs WHERE competition_id % 9 <> 0),
briefs AS (SELECT DISTINCT facility_type, competition_id, 'D' || CAST(competition_id AS STRING) AS brief_digest FROM subs WHERE competition_id % 4 <> 0)"""


@query(
    "cross_selection", "subs",
    CHOSEN.strip() + """,
    c AS (SELECT DISTINCT * FROM chosen),
    w AS (SELECT *, count(*) OVER (PARTITION BY request) AS n FROM c),
    k AS (SELECT request, company, count(DISTINCT competition_id) AS ci FROM c GROUP BY ALL),
    d AS (SELECT request, count(DISTINCT competition_id) AS dc FROM c GROUP BY ALL)
    SELECT w.request, w.facility_type, w.competition_id, w.company,
      CASE WHEN ci > 1 THEN w.company || ' (' || coalesce(p.competition_name, CAST(w.competition_id AS VARCHAR)) || ')' ELSE w.company END AS label,
      dc <= 1 AS shared_brief, CASE WHEN dc > 1 THEN brief_digest END AS brief_digest
    FROM w JOIN k USING (request, company) JOIN d USING (request) LEFT JOIN projects p USING (facility_type, competition_id) LEFT JOIN briefs USING (facility_type, competition_id) WHERE n >= 2""",
)
def cross_selection(t: Tables):
    part = lambda name: t.sql("SELECT * FROM (WITH " + CHOSEN + f" SELECT * FROM {name})", "subs")
    return comparison.cross_selection(part("chosen").distinct(), part("named"), part("projects"), part("briefs"), ["request"])


@query(
    "reference_cases", "subs",
    """c AS (SELECT facility_type, competition_id, max(created_at) AS created_at FROM subs GROUP BY ALL)
    SELECT facility_type, doc_id, competition_id, rank FROM (SELECT s.facility_type, s.doc_id, s.competition_id,
      row_number() OVER (PARTITION BY s.facility_type ORDER BY c.created_at DESC, s.doc_id) AS rank
      FROM subs s JOIN c USING (facility_type, competition_id) WHERE s.result <> 'lose' AND s.priority <> '5-LOW') WHERE rank <= 3""",
)
def reference_cases(t: Tables):
    subs = t.view("subs")
    projects = subs.groupBy("facility_type", "competition_id").agg(F.max("created_at").alias("created_at")).withColumn(
        "competition_name", F.lit(None).cast("string")
    )
    winners = subs.filter("result <> 'lose'").drop("created_at").withColumn(
        "main_strategy", F.when(F.col("priority") != "5-LOW", F.col("priority"))
    )
    return comparison.reference_cases(winners, projects, ["doc_id"], 3).select("facility_type", "doc_id", "competition_id", "rank")


@query(
    "comparison_excerpts", "subs",
    """c AS (SELECT facility_type, competition_id, max(created_at) AS created_at FROM subs GROUP BY ALL)
    SELECT facility_type, competition_id, axis_ord, text, rank FROM (SELECT s.facility_type, s.competition_id, s.doc_id AS axis_ord, s.priority AS text,
      row_number() OVER (PARTITION BY s.facility_type ORDER BY c.created_at DESC, s.competition_id, s.doc_id) AS rank
      FROM subs s JOIN c USING (facility_type, competition_id) WHERE length(trim(s.priority)) >= 10) WHERE rank <= 4""",
)
def comparison_excerpts(t: Tables):
    subs = t.view("subs")
    projects = subs.groupBy("facility_type", "competition_id").agg(F.max("created_at").alias("created_at"))
    texts = subs.select("facility_type", "competition_id", F.col("doc_id").alias("axis_ord"), F.col("priority").alias("text"))
    return comparison.comparison_excerpts(texts, projects, 4).drop("created_at")


ZONES = """
zones AS (SELECT l_orderkey AS doc_id, l_linenumber AS alt, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord, 'z' || CAST(l_suppkey % 4 AS STRING) AS program,
    'p' || CAST(l_partkey % 5 AS STRING) AS plan, 'l' || l_returnflag AS level, l_discount > 0.07 AS required FROM lineitem)"""


@query(
    "lock_alternatives", "",
    "WITH " + ZONES.strip() + """,
    canon AS (SELECT doc_id, program, arg_min(plan, ord) AS cp, arg_min(level, ord) AS cl FROM zones WHERE alt = 1 AND required GROUP BY ALL),
    kept AS (SELECT doc_id, alt FROM zones WHERE alt > 1 GROUP BY ALL),
    z AS (SELECT zones.* FROM zones JOIN kept USING (doc_id, alt))
    SELECT z.doc_id, z.alt, z.program, coalesce(cp, plan) AS plan, coalesce(cl, level) AS level, cp IS NOT NULL OR required AS required, false AS added FROM z LEFT JOIN canon USING (doc_id, program)
    UNION ALL SELECT k.doc_id, k.alt, c.program, c.cp, c.cl, true, true FROM kept k JOIN canon c USING (doc_id)
      WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = k.doc_id AND z.alt = k.alt AND z.program = c.program)""",
)
def lock_alternatives(t: Tables):
    zones = t.sql("WITH " + ZONES + " SELECT * FROM zones")
    return comparison.lock_alternatives(zones.filter("alt = 1"), zones.filter("alt > 1"), ["doc_id"])


@query(
    "axis_rubric", "subs",
    """f AS (SELECT DISTINCT facility_type, CASE WHEN facility_type = 'public' THEN 'redev' ELSE 'general' END AS grp FROM subs),
    b AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'redev' ELSE 'general' END AS grp, p_name AS axis, count(*) AS n FROM part GROUP BY ALL),
    o AS (SELECT DISTINCT 'public' AS facility_type, p_name AS axis, 'hint ' || p_name AS rubric_hint FROM part WHERE p_type = 'PROMO')
    SELECT f.facility_type, b.axis, CAST(n AS VARCHAR) || CASE WHEN o.axis IS NOT NULL THEN '|extra' ELSE '' END AS signals, coalesce(rubric_hint, '') AS rubric_hint
    FROM f JOIN b USING (grp) LEFT JOIN o ON o.facility_type = f.facility_type AND o.axis = b.axis""",
)
def axis_rubric(t: Tables):
    facilities = t.sql("SELECT DISTINCT facility_type, CASE WHEN facility_type = 'public' THEN 'redev' ELSE 'general' END AS `group` FROM subs", "subs")
    base = t.sql("SELECT CASE WHEN p_size % 2 = 0 THEN 'redev' ELSE 'general' END AS `group`, p_name AS axis, array(CAST(count(*) AS STRING)) AS signals FROM part GROUP BY 1, 2")
    override = t.sql("SELECT DISTINCT 'public' AS facility_type, p_name AS axis, array('extra') AS signals_extra, 'hint ' || p_name AS rubric_hint FROM part WHERE p_type = 'PROMO'")
    out = comparison.axis_rubric(base, override, facilities)
    return out.select("facility_type", "axis", F.array_join("signals", "|").alias("signals"), "rubric_hint")


@query(
    "pattern_summary", "subs keywords",
    """lines AS (SELECT s.facility_type, CASE l.l_returnflag WHEN 'A' THEN 'winner_patterns' WHEN 'N' THEN 'loser_patterns' ELSE 'key_differentiators' END AS kind, p.p_name || ' ' || p.p_type AS text
        FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.l_partkey),
    kw AS (SELECT facility_type, CASE cohort WHEN 'win' THEN 'winner_keywords' ELSE 'loser_keywords' END AS section, keyword AS text, count(*) AS n FROM keywords WHERE keyword <> '' GROUP BY ALL),
    every AS (SELECT * FROM kw UNION ALL SELECT facility_type, kind, text, count(*) FROM lines GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY facility_type, section ORDER BY n DESC, text) AS rank FROM every),
    won AS (SELECT facility_type, count(*) FILTER (cohort = 'win') AS win_n, count(*) FILTER (cohort = 'lose') AS lose_n FROM subs GROUP BY facility_type)
    SELECT facility_type, win_n, lose_n, section, rank, text FROM ranked JOIN won USING (facility_type)
    WHERE win_n > 0 AND rank <= CASE section WHEN 'winner_keywords' THEN 8 WHEN 'loser_keywords' THEN 8 WHEN 'key_differentiators' THEN 4 ELSE 5 END""",
)
def pattern_summary(t: Tables):
    sizes = t.view("subs").groupBy("facility_type", "cohort").agg(F.count("*").alias("size"))
    freq = patterns.term_frequency(t.view("keywords"), sizes, ["facility_type", "cohort"], "keyword", 8)
    lines = t.sql(
        """SELECT s.facility_type, CASE l.l_returnflag WHEN 'A' THEN 'winner_patterns' WHEN 'N' THEN 'loser_patterns' ELSE 'key_differentiators' END AS kind,
           p.p_name || ' ' || p.p_type AS text FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.l_partkey""",
        "subs",
    )
    limits = {"winner_keywords": 8, "loser_keywords": 8, "winner_patterns": 5, "loser_patterns": 5, "key_differentiators": 4}
    return comparison.pattern_summary(sizes, freq, patterns.frequent_lines(lines, ["facility_type"]), limits)


# --- search --------------------------------------------------------------------------

W = fixed.SEARCH_WEIGHTS


def _bm25(phrases: list[str], docs: str, key: str, weights: dict[str, float]) -> str:
    """BM25 in SQL for phrases that cannot overlap themselves."""

    def count(p: str) -> str:
        return " + ".join(
            f"{w}E0 * ((length({c}) - length(replace(lower({c}), '{p}', ''))) // {len(p)})" for c, w in weights.items()
        )

    length = " + ".join(f"greatest(length({c}) - 2, 0)" for c in weights)
    counts = ", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))
    totals = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(phrases)))
    terms = " ".join(
        f"- CASE WHEN ln((t.n - n{i} + 0.5E0) / (n{i} + 0.5E0)) <= 0 THEN 1e-6 ELSE ln((t.n - n{i} + 0.5E0) / (n{i} + 0.5E0)) END"
        f" * f{i} * 2.2E0 / (f{i} + 1.2E0 * (0.25E0 + 0.75E0 * len / avg_len))"
        for i in range(len(phrases))
    )
    hit = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""m AS (SELECT {key}, CAST({length} AS DOUBLE) AS len, {counts} FROM {docs}),
    t AS (SELECT count(*) AS n, avg(len) AS avg_len, {totals} FROM m),
    scored AS (SELECT {key}, 0.0E0 {terms} AS score FROM m, t WHERE {hit})"""


_STORED: dict[tuple[str, str, str], str] = {}


def _stored_index(t: Tables, name: str, docs, key: str, columns: list[str], **options) -> search_index.Index:
    """The stored index of one collection, written once per session and folder."""
    at = (t.spark.sparkContext.applicationId, t.folder, name)
    if at not in _STORED:
        path = f"{files.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
        search_index.build_index(docs(), key, columns, path, **options)
        _STORED[at] = path
    return search_index.Index(t.spark, _STORED[at])


def _parts(t: Tables) -> search_index.Index:
    return _stored_index(t, "part_docs", lambda: t.view("part_docs"), "competition_id", list(W), buckets=16, splits=1)


def _documents(t: Tables) -> search_index.Index:
    return _stored_index(t, "documents", lambda: t.table("documents"), "doc_id", ["text", "source"])


def prepare_indexes(spark, folder: str) -> None:
    """Write the stored indexes that the searches of a session share."""
    t = Tables(spark, folder)
    _parts(t)
    _documents(t)


_ANY_COLUMN = " || chr(10) || ".join(W)


@query("phrase_search", "part_docs", f"SELECT competition_id FROM part_docs WHERE contains(lower({_ANY_COLUMN}), 'red wid')")
def phrase_search(t: Tables):
    return search_index.phrase_matches(_parts(t), "Red Wid")


@query(
    "bm25_search", "part_docs",
    _bm25(["small"], "part_docs", "competition_id", W) + f" SELECT competition_id, {R4('score')} AS score FROM scored",
)
def bm25_search(t: Tables):
    return search_index.bm25(_parts(t), ["small"], W).withColumn("score", r4("score"))


@query(
    "or_search", "part_docs",
    _bm25(["promo", "brand#12", "blue"], "part_docs", "competition_id", W) + f" SELECT competition_id, {R4('score')} AS score FROM scored",
)
def or_search(t: Tables):
    return search_index.bm25(_parts(t), ["PROMO", "Brand#12", "blue", "xy"], W).withColumn("score", r4("score"))


@query(
    "document_search", "",
    "WITH " + _bm25(["with the", "inthe"], "documents", "doc_id", {"text": 1.0, "source": 0.5}) + f" SELECT doc_id, {R4('score')} AS score FROM scored",
)
def document_search(t: Tables):
    return search_index.bm25(_documents(t), ["with the", "inthe"], {"text": 1.0, "source": 0.5}).withColumn("score", r4("score"))


@query(
    "top_search", "part_docs",
    _bm25(["small"], "part_docs", "competition_id", W) + f" SELECT competition_id, {R4('score')} AS score FROM scored ORDER BY score, competition_id LIMIT 20",
)
def top_search(t: Tables):
    return search_index.search(_parts(t), ["small"], W, limit=20).withColumn("score", r4("score"))


@query(
    "routed_search", "part_docs",
    _bm25(["large"], "part_docs", "competition_id", W) + f""", top AS (SELECT s.* FROM scored s JOIN part_docs p USING (competition_id) WHERE p_size % 2 = 1 ORDER BY score, competition_id LIMIT 50)
    SELECT competition_id, {R4('score')} AS score FROM top""",
)
def routed_search(t: Tables):
    cards = t.view("part_docs").select("competition_id", F.lit("public").alias("facility_type"), (F.col("p_size") % 2).alias("winners"))
    out = search_index.routed_search(_parts(t), cards, "large", W, facility="public", result="win", limit=50)
    return out.select("competition_id", r4("score").alias("score"))


@query(
    "scanned_search", "",
    "WITH " + _bm25(["tion of", "heit"], "documents", "doc_id", {"text": 1.0}) + f" SELECT doc_id, {R4('score')} AS score FROM scored",
)
def scanned_search(t: Tables):
    """Without an index: one scan of the texts."""
    return search.bm25(t.table("documents"), "doc_id", ["tion of", "heit"], {"text": 1.0}).withColumn("score", r4("score"))


@query(
    "word_search", "",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    m AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS len, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS DOUBLE) AS f0,
        CAST(len(list_filter(w, lambda x: x = 'que')) AS DOUBLE) AS f1 FROM w),
    t AS (SELECT count(*) AS n, avg(len) AS avg_len, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM m),
    scored AS (SELECT doc_id, 0.0E0 - CASE WHEN ln((t.n - n0 + 0.5E0) / (n0 + 0.5E0)) <= 0 THEN 1e-6 ELSE ln((t.n - n0 + 0.5E0) / (n0 + 0.5E0)) END * f0 * 2.2E0 / (f0 + 1.2E0 * (0.25E0 + 0.75E0 * len / avg_len))
        - CASE WHEN ln((t.n - n1 + 0.5E0) / (n1 + 0.5E0)) <= 0 THEN 1e-6 ELSE ln((t.n - n1 + 0.5E0) / (n1 + 0.5E0)) END * f1 * 2.2E0 / (f1 + 1.2E0 * (0.25E0 + 0.75E0 * len / avg_len)) AS score
        FROM m, t WHERE f0 > 0 OR f1 > 0)
    SELECT doc_id, {R4('score')} AS score FROM scored""",
)
def word_search(t: Tables):
    """The same over words, where parts of words are not searched."""
    index = _stored_index(t, "document_words", lambda: t.table("documents"), "doc_id", ["text"], tokens="word")
    return search_index.bm25(index, ["Of the", "que"], {"text": 1.0}).withColumn("score", r4("score"))


@query(
    "index_refresh", "",
    """WITH now AS (
        SELECT p_partkey AS id, lower(CASE WHEN p_size % 5 = 0 THEN p_type || ' ' || p_name ELSE p_name END) AS name, lower(p_brand) AS brand FROM part WHERE p_size % 7 <> 0
        UNION ALL SELECT 1000000000 + c_custkey, lower(c_name), lower(c_mktsegment) FROM customer),
    grams AS (SELECT id, unnest([substr(name, i::INT, 3) for i in range(1, length(name) - 1)]) AS gram FROM now
        UNION ALL SELECT id, unnest([substr(brand, i::INT, 3) for i in range(1, length(brand) - 1)]) FROM now)
    SELECT gram, count(DISTINCT id) AS docs, count(*) AS places FROM grams GROUP BY gram
    UNION ALL SELECT '', count(*), CAST(sum(greatest(length(name) - 2, 0) + greatest(length(brand) - 2, 0)) AS BIGINT) FROM now""",
)
def index_refresh(t: Tables):
    """Postings and totals (the row without a gram) of an index after two batches, each delivered twice."""
    path = f"{files.shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    base = t.sql("SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part")
    search_index.build_index(base, "id", ["name", "brand"], path, buckets=8, splits=1)
    first = t.sql(
        """SELECT p_partkey AS id, 'upsert' AS op, 1 AS seq, p_type || ' ' || p_name AS name, p_brand AS brand FROM part WHERE p_size % 5 = 0
        UNION ALL SELECT 1000000000 + c_custkey, 'upsert', 1, c_name, 'before' FROM customer"""
    )
    second = t.sql(
        """SELECT p_partkey AS id, 'delete' AS op, 2 AS seq, '' AS name, '' AS brand FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT 1000000000 + c_custkey, 'upsert', 2, c_name, c_mktsegment FROM customer
        UNION ALL SELECT 1000000000 + c_custkey, 'delete', 1, '', '' FROM customer"""
    )
    for number, batch in enumerate((first, first, second, second)):
        index = search_index.apply_batch(t.spark, path, batch, "changes", number // 2)
    grams = index.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("at")).alias("places"))
    totals = index.documents().limit(0).groupBy().agg(
        F.lit("").alias("gram"), F.lit(index.state["docs"]).cast("long").alias("docs"), F.lit(index.state["length"]).cast("long").alias("places")
    )
    return grams.unionByName(totals)


@query(
    "trigram_postings", "",
    """WITH d AS (SELECT conv_id * 100 + turn AS id, lower(text) AS x FROM conversations)
    SELECT id, count(DISTINCT g) AS grams FROM (SELECT id, unnest([substr(x, CAST(i AS INT), 3) for i in range(1, length(x) - 1)]) AS g FROM d) GROUP BY id""",
)
def trigram_postings(t: Tables):
    docs = t.sql("SELECT conv_id * 100 + turn AS id, text FROM conversations")
    return search.postings(docs, "id", ["text"]).groupBy("id").agg(F.count("gram").alias("grams"))


@query(
    "posting_candidates", "",
    """SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'hei') AND contains(lower(text), 'ein')""",
)
def posting_candidates(t: Tables):
    index = search.postings(t.table("documents"), "doc_id", ["text"])
    return search.phrase_candidates(index, "thein", "doc_id")


@query(
    "search_documents", "subs",
    """p AS (SELECT competition_id, any_value(facility_type) AS facility_type, count(*) AS n, count(*) FILTER (WHERE result <> 'lose') AS w,
        string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS ranking FROM subs GROUP BY 1)
    SELECT CAST(competition_id AS VARCHAR) AS competition_id, CASE facility_type WHEN 'public' THEN 'public 공공시설 공공시설 시청 구청 관공서 청사 도서관 문화시설 체육관'
        WHEN 'residential' THEN 'residential 주거시설 주거시설 공동주택 아파트 단지 주거' WHEN 'industrial' THEN 'industrial 산업시설 산업시설 공장 물류센터 산업단지'
        WHEN 'transport' THEN 'transport 교통시설 교통시설 역사 터미널 환승센터 철도역 버스터미널' ELSE 'commercial 상업시설 상업시설 쇼핑몰 백화점 마트 상가' END AS facility_text,
      ranking, CASE WHEN w > 3 THEN 'high' ELSE '' END AS alignment,
      CASE WHEN competition_id % 2 = 0 THEN 'turnkey 턴키 일괄입찰 기술제안 ' ELSE '' END || 'cm CM 사업관리 감리 n' || n || CASE WHEN competition_id % 3 = 0 THEN ' deep ' || n || ' kw' ELSE '' END AS extra_meta
    FROM p""",
)
def search_documents(t: Tables):
    base = t.view("subs").groupBy("competition_id").agg(
        F.first("facility_type").alias("facility_type"), F.count("*").alias("n"), F.count_if(F.col("result") != "lose").alias("w"),
        F.transform(F.sort_array(F.collect_list("doc_id")), lambda d: d.cast("string")).alias("ranking"),
    )
    projects = base.select(
        "competition_id", "facility_type",
        F.when(F.col("competition_id") % 2 == 0, F.lit("turnkey")).otherwise(F.lit("")).alias("procurement_type"),
        F.lit("cm").alias("project_phase"), F.concat(F.lit("n"), "n").alias("memo"),
    )
    nothing = F.array().cast("array<string>")
    insights = base.select(
        "competition_id", "ranking", nothing.alias("differentiators"), nothing.alias("strengths"),
        F.when(F.col("w") > 3, F.lit("high")).alias("alignment"),
    )
    deep = search.deep_text(
        base.filter("competition_id % 3 = 0").select(
            "competition_id", F.col("n").alias("ord"), F.concat(F.lit("deep "), "n").alias("concept_narrative"), F.lit(" ").alias("design_intent"),
            nothing.alias("key_differentiators"), F.array(F.lit("kw")).alias("search_keywords"), nothing.alias("improvement_points"),
        ),
        ["competition_id"], "ord",
    )
    out = search.search_documents(projects, insights, deep, ["memo"])
    return out.select("competition_id", "facility_text", "ranking", "alignment", "extra_meta")
