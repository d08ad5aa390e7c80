"""Queries on measures and outcome patterns."""

from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.operators import audit, measures, patterns
from dossierlake.plans.adapters import Tables
from dossierlake.plans.adapters import r4 as R4
from dossierlake.plans.adapters import r8 as R8
from dossierlake.plans.registry import query, r4, r8

# the consistency rules once more, as SQL over the view ``quant``
FLAGS = """
flags AS (
  SELECT doc_id, facility_type, cohort, 'building_gt_site' AS rule, 'error' AS severity,
         'building_area_sqm,site_area_sqm' AS fields
  FROM quant WHERE site_area_sqm <> 0 AND building_area_sqm <> 0 AND building_area_sqm > site_area_sqm * 1.02E0
  UNION ALL
  SELECT doc_id, facility_type, cohort, 'coverage_mismatch', 'error',
         'building_coverage_ratio_pct,building_area_sqm,site_area_sqm'
  FROM quant WHERE site_area_sqm <> 0 AND building_area_sqm <> 0
    AND abs(100.0E0 * building_area_sqm / site_area_sqm - building_coverage_ratio_pct) > 3
  UNION ALL
  SELECT doc_id, facility_type, cohort, 'far_above_ground_mismatch', 'error',
         'floor_area_ratio_pct,area_above_ground_sqm,site_area_sqm'
  FROM quant WHERE site_area_sqm <> 0 AND area_above_ground_sqm <> 0
    AND abs(100.0E0 * area_above_ground_sqm / site_area_sqm - floor_area_ratio_pct) > 5
  UNION ALL
  SELECT doc_id, facility_type, cohort, 'floor_area_below_far_implied', 'error',
         'total_floor_area_sqm,floor_area_ratio_pct,site_area_sqm'
  FROM quant WHERE site_area_sqm <> 0 AND coalesce(area_above_ground_sqm, 0) = 0 AND total_floor_area_sqm <> 0
    AND total_floor_area_sqm < floor_area_ratio_pct / 100.0E0 * site_area_sqm * 0.9E0
  UNION ALL SELECT doc_id, facility_type, cohort, 'out_of_bounds', 'error', 'building_coverage_ratio_pct'
  FROM quant WHERE building_coverage_ratio_pct NOT BETWEEN 0 AND 100
  UNION ALL SELECT doc_id, facility_type, cohort, 'out_of_bounds', 'error', 'floor_area_ratio_pct'
  FROM quant WHERE floor_area_ratio_pct NOT BETWEEN 0 AND 1500
  UNION ALL SELECT doc_id, facility_type, cohort, 'out_of_bounds', 'error', 'floors_above'
  FROM quant WHERE floors_above NOT BETWEEN 0 AND 120
  UNION ALL SELECT doc_id, facility_type, cohort, 'out_of_bounds', 'error', 'floors_below'
  FROM quant WHERE floors_below NOT BETWEEN 0 AND 12
  UNION ALL SELECT doc_id, facility_type, cohort, 'out_of_bounds', 'error', 'parking_count'
  FROM quant WHERE parking_count NOT BETWEEN 0 AND 50000
  UNION ALL SELECT doc_id, facility_type, cohort, 'coverage_gt_far', 'warn', 'building_coverage_ratio_pct,floor_area_ratio_pct'
  FROM quant WHERE building_coverage_ratio_pct > floor_area_ratio_pct + 1)"""

_UNPIVOT = "\n  UNION ALL ".join(
    f"SELECT doc_id, facility_type, cohort, competition_id, result, '{f}' AS field, {f} AS value "
    f"FROM quant WHERE {f} IS NOT NULL"
    for f in fixed.STAT_MEASURES
)
CLEAN = FLAGS + f""",
bad AS (SELECT DISTINCT doc_id, unnest(string_split(fields, ',')) AS field FROM flags WHERE severity = 'error'),
every AS ({_UNPIVOT}),
clean AS (SELECT e.* FROM every e ANTI JOIN bad b ON e.doc_id = b.doc_id AND e.field = b.field)"""

STATS = CLEAN + """,
stats AS (SELECT facility_type, cohort, field, avg(value) AS mean,
          CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS std, count(*) AS n
          FROM clean GROUP BY ALL)"""

PAGES = """
pstats AS (
  SELECT facility_type, cohort, key, avg(v) AS mean,
         CASE WHEN count(*) > 1 THEN stddev_samp(v) ELSE 0 END AS std, count(*) AS n
  FROM (SELECT facility_type, cohort, primary_type AS key, CAST(pages AS DOUBLE) AS v FROM page_counts
        UNION ALL
        SELECT facility_type, cohort, primary_type || '_ratio', round_even(pages / total_pages, 3) FROM page_counts)
  GROUP BY ALL)"""

SIZES = "sizes AS (SELECT facility_type, cohort, count(*) AS size FROM subs GROUP BY ALL)"
FREQ = SIZES + """,
kw AS (SELECT *, row_number() OVER (PARTITION BY facility_type, cohort ORDER BY occurrences DESC, keyword) AS rank
       FROM (SELECT facility_type, cohort, keyword, count(*) AS occurrences FROM keywords WHERE keyword <> '' GROUP BY ALL)),
freqs AS (SELECT k.facility_type, k.cohort, k.keyword, k.occurrences, k.rank, k.occurrences / s.size AS freq
          FROM kw k JOIN sizes s USING (facility_type, cohort))"""


@query("quant_flags", "quant", FLAGS + " SELECT doc_id, rule, severity, fields FROM flags")
def quant_flags(t: Tables):
    return measures.measure_flags(t.view("quant"), ["doc_id"]).select(
        "doc_id", "rule", "severity", F.array_join("fields", ",").alias("fields")
    )


@query(
    "defect_gate", "quant",
    FLAGS + """ SELECT facility_type, count(*) FILTER (WHERE severity = 'error') AS errors,
      count(*) FILTER (WHERE severity = 'warn') AS warnings,
      count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM flags GROUP BY facility_type""",
)
def defect_gate(t: Tables):
    flags = measures.measure_flags(t.view("quant"), ["facility_type"])
    return measures.defect_gate(flags, ["facility_type"])


@query(
    "measure_stats", "quant",
    STATS + f" SELECT facility_type, cohort, field, {R4('mean')} AS mean, {R4('std')} AS std, n FROM stats",
)
def measure_stats(t: Tables):
    keys = ["facility_type", "cohort"]
    stats = measures.grouped_stats(measures.clean_values(t.view("quant"), keys), [*keys, "field"])
    return stats.select(*keys, "field", r4("mean").alias("mean"), r4("std").alias("std"), "n")


@query(
    "missing_map", "quant",
    "SELECT doc_id, " + ", ".join(f"{f} IS NOT NULL AS has_{f}" for f in fixed.STAT_MEASURES) + " FROM quant",
)
def missing_map(t: Tables):
    return measures.missing_map(t.view("quant"), ["doc_id"])


@query(
    "page_distribution", "cls",
    "SELECT doc_id, type, count(*) AS pages FROM cls GROUP BY ALL",
)
def page_distribution(t: Tables):
    return patterns.page_distribution(t.view("cls"), ["doc_id"], "type")


@query(
    "page_share", "subs cls page_counts",
    f"""SELECT doc_id, primary_type, pages, CAST(floor(100.0E0 * pages / total_pages + 0.5) AS INT) AS pct_rounded,
      CAST(floor(100.0E0 * pages / total_pages) AS INT) AS pct_truncated,
      {R4('round_even(100.0E0 * pages / total_pages, 1)')} AS pct_decimal FROM page_counts""",
)
def page_share(t: Tables):
    shares = patterns.page_share(t.view("page_counts"))
    return shares.select(
        "doc_id", "primary_type", "pages", "pct_rounded", "pct_truncated", r4("pct_decimal").alias("pct_decimal")
    )


@query(
    "page_stats", "page_counts",
    PAGES + f" SELECT facility_type, cohort, key, {R8('mean')} AS mean, {R8('std')} AS std, n FROM pstats",
)
def page_stats(t: Tables):
    keys = ["facility_type", "cohort"]
    stats = patterns.page_stats(t.view("page_counts"), keys)
    return stats.select(*keys, "key", r8("mean").alias("mean"), r8("std").alias("std"), "n")


@query(
    "facility_pattern", "quant page_counts keywords mass_types",
    STATS + "," + PAGES + "," + FREQ + f""",
    masses AS (SELECT m.facility_type, m.cohort, m.mass_type, count(*) AS occurrences, count(*) / any_value(s.size) AS freq
      FROM mass_types m JOIN sizes s USING (facility_type, cohort) WHERE m.cohort = 'win' GROUP BY ALL),
    pattern AS (
      SELECT facility_type, cohort, 'count' AS family, 'records' AS key, NULL AS mean, NULL AS std, size AS n, NULL AS freq FROM sizes
      UNION ALL SELECT facility_type, cohort, 'page_distribution', key, mean, std, n, NULL FROM pstats
      UNION ALL SELECT facility_type, cohort, 'quantitative', field, mean, std, n, NULL FROM stats
      UNION ALL SELECT facility_type, cohort, 'concept_keywords', keyword, NULL, NULL, occurrences, freq FROM freqs
      UNION ALL SELECT facility_type, cohort, 'mass_types', mass_type, NULL, NULL, occurrences, freq FROM masses)
    SELECT facility_type, cohort, family, key, CASE WHEN family = 'quantitative' THEN {R4('mean')} ELSE {R8('mean')} END AS mean,
      CASE WHEN family = 'quantitative' THEN {R4('std')} ELSE {R8('std')} END AS std, n, freq
    FROM pattern WHERE facility_type IN (SELECT facility_type FROM sizes WHERE cohort = 'win')""",
)
def facility_pattern(t: Tables):
    out = patterns.facility_pattern(
        t.view("subs"), t.view("page_counts"), t.view("quant"), t.view("keywords"), t.view("mass_types")
    )
    large = F.col("family") == "quantitative"
    shown = {c: F.when(large, r4(c)).otherwise(r8(F.when(~large, F.col(c)))) for c in ("mean", "std")}
    return out.select(
        "facility_type", "cohort", "family", "key", *[e.alias(c) for c, e in shown.items()], "n", "freq"
    )


@query(
    "selected_pattern", "quant",
    CLEAN + f""" SELECT field, {R4('avg(value)')} AS mean,
      {R4('CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END')} AS std, count(*) AS n
      FROM clean WHERE competition_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY field""",
)
def selected_pattern(t: Tables):
    chosen = t.table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("competition_id"))
    stats = patterns.selected_pattern(
        t.view("quant"), chosen, ["competition_id"],
        lambda q: measures.grouped_stats(measures.clean_values(q, []), ["field"]),
    )
    return stats.select("field", r4("mean").alias("mean"), r4("std").alias("std"), "n")


@query(
    "keyword_freq", "subs keywords",
    FREQ + f" SELECT facility_type, cohort, keyword, occurrences, freq FROM freqs",
)
def keyword_freq(t: Tables):
    keys = ["facility_type", "cohort"]
    freqs = patterns.term_frequency(t.view("keywords"), patterns.cohort_sizes(t.view("subs")), keys, "keyword")
    return freqs.select(*keys, "keyword", "occurrences", "freq")


@query(
    "keyword_lift", "subs keywords",
    FREQ + f""" SELECT w.facility_type, w.keyword, w.freq AS win_freq, coalesce(l.freq, 0) AS lose_freq,
      CASE WHEN w.freq - coalesce(l.freq, 0) > 0.2E0 THEN 'positive' WHEN w.freq - coalesce(l.freq, 0) < -0.2E0 THEN 'negative'
           ELSE 'neutral' END AS lift
      FROM freqs w LEFT JOIN freqs l ON l.facility_type = w.facility_type AND l.keyword = w.keyword AND l.cohort = 'lose'
      WHERE w.cohort = 'win'""",
)
def keyword_lift(t: Tables):
    keys = ["facility_type", "cohort"]
    freqs = patterns.term_frequency(t.view("keywords"), patterns.cohort_sizes(t.view("subs")), keys, "keyword")
    lift = patterns.keyword_lift(freqs, ["facility_type"])
    return lift.select("facility_type", "keyword", "win_freq", "lose_freq", "lift")


@query(
    "cohort_compare", "page_counts",
    PAGES + f""", both_sides AS (
      SELECT coalesce(w.facility_type, l.facility_type) AS facility_type, coalesce(w.key, l.key) AS key,
             w.mean AS win_mean, l.mean AS lose_mean
      FROM (SELECT * FROM pstats WHERE cohort = 'win') w
      FULL JOIN (SELECT * FROM pstats WHERE cohort = 'lose') l ON w.facility_type = l.facility_type AND w.key = l.key)
    SELECT facility_type, key, {R8('win_mean')} AS win_mean, {R8('lose_mean')} AS lose_mean,
      {R8('greatest(max(coalesce(win_mean, 0)) OVER (PARTITION BY facility_type), max(coalesce(lose_mean, 0)) OVER (PARTITION BY facility_type), 0.1E0)')} AS scale
    FROM both_sides""",
)
def cohort_compare(t: Tables):
    table = patterns.cohort_table(patterns.page_stats(t.view("page_counts"), ["facility_type", "cohort"]), ["facility_type"])
    return table.select(
        "facility_type", "key", r8("win_mean").alias("win_mean"), r8("lose_mean").alias("lose_mean"), r8("scale").alias("scale")
    )


@query(
    "submission_vs_cohort", "quant",
    STATS + f""",
    sides AS MATERIALIZED (SELECT facility_type, field, max(mean) FILTER (WHERE cohort = 'win') AS win, max(mean) FILTER (WHERE cohort = 'lose') AS lose
      FROM stats GROUP BY facility_type, field)
    SELECT e.doc_id, e.field, e.value, {R4('win')} AS win_mean, {R4('lose')} AS lose_mean,
      CASE WHEN e.value < win * 0.85E0 THEN 'low' WHEN e.value >= win * 0.95E0 THEN 'ok' ELSE 'info' END AS status
    FROM every e LEFT JOIN sides USING (facility_type, field)""",
)
def submission_vs_cohort(t: Tables):
    quant = t.view("quant")
    keys = ["facility_type", "cohort"]
    stats = measures.grouped_stats(measures.clean_values(quant, keys), [*keys, "field"])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fixed.STAT_MEASURES])
    values = quant.select("doc_id", "facility_type", F.inline(pairs)).filter("value IS NOT NULL")
    out = measures.value_against_cohorts(values, stats, ["facility_type"])
    return out.select(
        "doc_id", "field", "value", r4("win_mean").alias("win_mean"), r4("lose_mean").alias("lose_mean"), "status"
    )


@query(
    "recommended_range", "quant",
    CLEAN + """ SELECT competition_id, field, coalesce(min(value) FILTER (WHERE result IN ('win','contracted')), min(value)) AS low,
      coalesce(max(value) FILTER (WHERE result IN ('win','contracted')), max(value)) AS high,
      abs(coalesce(max(value) FILTER (WHERE result IN ('win','contracted')), max(value))
        - coalesce(min(value) FILTER (WHERE result IN ('win','contracted')), min(value))) < 1e-6 AS single
    FROM every GROUP BY competition_id, field""",
)
def recommended_range(t: Tables):
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fixed.STAT_MEASURES])
    values = t.view("quant").select("competition_id", "result", F.inline(pairs)).filter("value IS NOT NULL")
    return measures.recommended_range(values, ["competition_id", "field"])


@query(
    "project_rollup", "subs",
    """SELECT facility_type, competition_id, count(*) AS submissions,
       count(*) FILTER (WHERE result IN ('win','contracted')) AS winners FROM subs GROUP BY ALL""",
)
def project_rollup(t: Tables):
    return patterns.project_rollup(t.view("subs"))


@query(
    "facility_rollup", "subs",
    """SELECT facility_type, count(DISTINCT competition_id) AS projects, count(*) AS submissions,
       count(*) FILTER (WHERE result IN ('win','contracted')) AS winners FROM subs GROUP BY facility_type""",
)
def facility_rollup(t: Tables):
    return patterns.facility_rollup(patterns.project_rollup(t.view("subs")))


@query(
    "sample_audit", "quant",
    STATS + """ SELECT s.facility_type, c.win_count, s.min_n, s.max_n, s.min_n < s.max_n AS unequal, c.win_count < 3 AS too_few
    FROM (SELECT facility_type, min(n) AS min_n, max(n) AS max_n FROM stats WHERE cohort = 'win' GROUP BY 1) s
    JOIN (SELECT facility_type, count(*) AS win_count FROM subs WHERE cohort = 'win' GROUP BY 1) c USING (facility_type)""",
)
def sample_audit(t: Tables):
    keys = ["facility_type", "cohort"]
    stats = measures.grouped_stats(measures.clean_values(t.view("quant"), keys), [*keys, "field"])
    sizes = patterns.cohort_sizes(t.view("subs"))
    pattern = stats.select(*keys, F.lit("quantitative").alias("family"), "n").unionByName(
        sizes.select(*keys, F.lit("count").alias("family"), F.col("size").alias("n"))
    )
    return audit.sample_audit(pattern)


@query(
    "sample_basis", "subs",
    """cases AS (SELECT facility_type, count(*) AS case_count FROM subs WHERE result = 'contracted' GROUP BY 1),
    comps AS (SELECT facility_type, count(DISTINCT competition_id) AS comparison_count FROM subs GROUP BY 1),
    base AS (SELECT facility_type, count(*) FILTER (WHERE cohort = 'win') AS win_n,
             count(*) FILTER (WHERE cohort = 'lose') AS lose_n FROM subs GROUP BY 1)
    SELECT facility_type, win_n, lose_n, coalesce(case_count, 0) AS case_count, comparison_count,
           win_n + lose_n + coalesce(case_count, 0) + comparison_count > 0 AS proceed
    FROM base LEFT JOIN cases USING (facility_type) JOIN comps USING (facility_type)""",
)
def sample_basis(t: Tables):
    subs = t.view("subs")
    comparisons = subs.select("facility_type", "competition_id").distinct()
    return patterns.sample_basis(subs, subs.filter("result = 'contracted'"), comparisons)


@query(
    "insight_lines", "subs",
    """lines AS (SELECT s.facility_type, s.competition_id,
        CASE l.l_returnflag WHEN 'A' THEN 'winner_strengths' WHEN 'N' THEN 'loser_weaknesses' ELSE 'key_differentiators' END AS kind,
        p.p_name || ' ' || p.p_type AS text
      FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.l_partkey),
    told AS (SELECT * FROM lines WHERE (facility_type, competition_id) IN
      (SELECT facility_type, competition_id FROM lines WHERE kind <> 'key_differentiators')),
    counted AS (SELECT facility_type, kind, text, count(*) AS occurrences FROM told GROUP BY ALL)
    SELECT facility_type, kind, text, occurrences, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY facility_type, kind ORDER BY occurrences DESC, text) AS rank FROM counted) WHERE rank <= 5""",
)
def insight_lines(t: Tables):
    lines = t.sql(
        """SELECT s.facility_type, s.competition_id,
           CASE l.l_returnflag WHEN 'A' THEN 'winner_strengths' WHEN 'N' THEN 'loser_weaknesses' ELSE 'key_differentiators' END AS kind,
           p.p_name || ' ' || p.p_type AS text
           FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.l_partkey""",
        "subs",
    )
    told = patterns.collect_insights(lines, ["facility_type", "competition_id"])
    return patterns.frequent_lines(told, ["facility_type"], 5)
