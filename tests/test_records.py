"""Nested records, validation rules, certificates, backfill and pivots on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import nested
from dossierlake.operators import areas, comparison, conflicts, pages, resolve, sheets, similar, sites
from dossierlake.plans.catalogue import QUERIES
from dossierlake.sources import readers, upserts


def random_record(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 4 else 5)
    if kind == 6 and depth:
        return [random_record(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind >= 6 or depth == 0:
        return {k: random_record(rng, depth + 1) for k in rng.sample(["_page", "a", 'x"_page', "_pages", "total_pages", "가"], rng.randint(1, 4))}
    return [rng.randint(-5, 90), rng.randint(0, 9) + 0.5, 'say "_page":7', True, None, "_page"][kind]


def brute_pages(record):
    if isinstance(record, list):
        return [p for x in record for p in brute_pages(x)]
    if not isinstance(record, dict):
        return []
    return [p for k, v in record.items() for p in ([int(v)] if k == "_page" and isinstance(v, (int, float)) else brute_pages(v))]


def test_pages_at_any_depth(spark):
    rng = random.Random(5)
    records = [random_record(rng) for _ in range(300)]
    deep = {"_page": 1}
    for n in range(60):
        deep = {"in": [deep], "_page": n} if n % 7 == 0 else {"in": deep}
    records.append(deep)
    rows = [(i, json.dumps(r, ensure_ascii=i % 2 == 0)) for i, r in enumerate(records)] + [(-1, "no json"), (-2, None)]
    got = spark.createDataFrame(rows, "i int, r string").select("i", nested.page_numbers("r").alias("p"), nested.page_bound("r").alias("b"))
    for row in got.collect():
        if row.i < 0:
            assert row.p is None and row.b is None
            continue
        pages, total = brute_pages(records[row.i]), records[row.i].get("total_pages")
        assert sorted(row.p) == sorted(pages)
        stated = int(total) if isinstance(total, (int, float)) and not isinstance(total, bool) and total > 0 else None
        assert row.b == (stated if stated is not None else max(pages, default=None)) or isinstance(total, (bool, str))


def test_equal_records_in_any_key_order(spark):
    rng = random.Random(6)

    def shuffled(r):
        if isinstance(r, dict):
            return {k: shuffled(r[k]) for k in rng.sample(list(r), len(r))}
        return [shuffled(x) for x in r] if isinstance(r, list) else r

    rows, order = [], {}
    for i in range(120):
        r = random_record(random.Random(i % 25))
        rows.append((i % 2, i, json.dumps(shuffled(r))))
        order.setdefault((i % 2, json.dumps(r, sort_keys=True)), []).append(i)
    got = resolve.distinct_records(spark.createDataFrame(rows, "k int, ord int, r string"), ["k"], "r")
    assert sorted((r.k, r.ord, r.copies) for r in got.collect()) == sorted((k, min(v), len(v)) for (k, _), v in order.items())


def test_all_six_rules(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    one = lambda *rows: frame(list(rows), "doc int, severity string")
    flags = conflicts.rule_flags(
        ["doc"], one((1, "high"), (2, "medium")), frame([(1, 3), (1, 1)], "doc int, pairs long"), one((1, "medium")), one((3, "high")), one((3, "high"), (3, "high")),
        frame([(2,), (2,), (1,)], "doc int"),
    )
    got = conflicts.validate_briefs(frame([(1,), (2,), (3,), (4,)], "doc int"), flags, ["doc"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5, 1, 4), (2, 0, 1, 2, 2), (3, 3, 0, 0, 2), (4, 0, 0, 0, 0)]


def test_certificates_and_costs(spark):
    rows = [(1, '{"renewable_energy_min_pct": 12.5}', 10.0), (2, '{"renewable_energy_min_pct": "12"}', None), (3, "{}", 1.0), (4, None, 2.0), (5, '{"renewable_energy_min_pct": 20}', 3.0)]
    briefs = spark.createDataFrame(rows, "doc int, j string, construction_cost_100m_won double").select(
        "*", F.parse_json("j").alias("sustain"), F.lit(1.0).alias("design_cost_100m_won"), F.lit(24).alias("construction_period_months")
    )
    certs = spark.createDataFrame([(1, 1, "녹색건축 우수", None), (1, 2, "ZEB", "3 등급"), (3, 1, "배리어프리 최우수", None)], "doc int, ord int, name string, required_grade string")
    got = {r.doc: r for r in sites.feasibility_projects(briefs, certs, ["doc"]).collect()}
    assert {d: r.renewable_pct for d, r in got.items()} == {1: 12.5, 2: None, 3: None, 4: None, 5: 20.0}
    assert (got[1].green_building, got[1].zeb_grade, got[3].bf_grade, got[1].construction_cost_100m_won) == ("우수", 3, "최우수", 10.0)


def test_limit_authority(spark):
    rows = [(1, "용적률은 심의로 정한다"), (1, "기타"), (2, "용적률 200%"), (3, None)]
    got = {r.doc: r.limits_determined_by for r in sites.limit_authority(spark.createDataFrame(rows, "doc int, text string"), ["doc"]).collect()}
    assert got == {1: "심의", 2: "법정", 3: "법정"}


def test_columns_found_in_the_data(spark):
    cells = spark.createDataFrame([(1, 2, "2F", "b", "core"), (1, 2, "2F", "a", "office"), (1, 3, "3F", "b", "culture")], "k int, floor_order int, floor string, company string, category string")
    got = comparison.floor_matrix(cells, ["k"])
    assert got.columns == ["k", "floor_order", "floor", "a", "b"] and sorted(map(tuple, got.collect())) == [(1, 2, "2F", "office", "core"), (1, 3, "3F", None, "culture")]
    with pytest.raises(ValueError):
        comparison.found_values(cells, "company", most=1)


def test_hierarchy_summary(spark):
    rows = spark.createDataFrame([(1, "space", "3"), (1, "note", None), (1, "facility", "4"), (2, "note", None)], "doc int, row_type string, area string")
    got = areas.hierarchy_summary(rows, spark.createDataFrame([(1, "x"), (1, "y")], "doc int, name string"), ["doc"])
    assert {(r.doc, r.area_filled, tuple(r.levels), r.shared) for r in got.collect()} == {(1, 2, ("facility", "space"), 2), (2, 0, (), 0)}


def test_backfill_is_idempotent(spark, tmp_path):
    import os

    path, ddl = str(tmp_path / "rows"), "doc int, address string, part string"
    upserts.write_partitions(spark.createDataFrame([(1, "", "p"), (2, "x", "p"), (3, "y", "q"), (4, "z", "r")], ddl), path, "part")
    new = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (2, "other", "p"), (3, " ", "q"), (5, "c", "q")], ddl)
    state = lambda: {(r.doc, r.address, r.part) for r in spark.read.parquet(path).collect()}
    files = lambda part: sorted(os.listdir(f"{path}/part={part}"))
    before, untouched = state(), files("r")
    planned = upserts.apply_backfill(spark, path, new, ["doc"], "address", "part")
    assert sorted(map(tuple, planned.collect())) == [(1, 0, 2), (5, 0, 1)] and state() == before
    upserts.apply_backfill(spark, path, new, ["doc"], "address", "part", dry_run=False)
    after = {(1, "a", "p"), (1, "b", "p"), (2, "x", "p"), (3, "y", "q"), (5, "c", "q"), (4, "z", "r")}
    assert state() == after and files("r") == untouched
    written = files("p")
    assert upserts.apply_backfill(spark, path, new, ["doc"], "address", "part", dry_run=False).isEmpty()
    assert state() == after and files("p") == written


@pytest.mark.parametrize("hot", [0, True])
def test_checklist_sheets(spark, tmp_path, hot):
    docs = spark.createDataFrame([("d",), ("none",), (None,)], "doc string")
    scoring = spark.createDataFrame(
        [("d", 1, "배치", "동선", 10.1), ("d", 2, "배치", "조망", 20.2), ("d", 3, None, "기타", None), ("d", 4, None, "등", 0.3), ("d", 5, "배치", "", 1.0), (None, 1, "구조", "x", 5.0)],
        "doc string, ord long, category string, detail string, points double",
    )
    got = [(r.part, r.label, r.text, r.amount) for r in sheets.scoring_sheet(scoring, ["doc"], hot).where("doc = 'd'").orderBy("part", "ord").collect()]
    assert got == [(1, "배치", "동선", 10.1), (1, None, "조망", 20.2), (1, None, "기타", None), (1, None, "등", 0.3), (1, "배치", "", 1.0), (2, "합계", None, 31.6)]
    flags = spark.createDataFrame(
        [("d", 1, "low", "c"), ("d", 2, "high", "a"), ("d", 3, "odd", "e"), ("d", 4, "medium", "b"), ("d", 5, None, "d"), (None, 1, "high", None)], "doc string, ord long, severity string, message string"
    )
    lines = sheets.warning_sheet(docs, flags, ["doc"]).orderBy("doc", "part", "ord").collect()
    of = lambda d: [(r.part, r.label, r.text, r.amount) for r in lines if r.doc == d]
    assert of("d") == [
        (0, "높음", None, 1.0), (0, "보통", None, 1.0), (0, "낮음", None, 2.0), (1, "높음", "a", None), (2, "보통", "b", None), (3, "낮음", "c", None), (3, "odd", "e", None), (3, "낮음", "d", None),
    ]
    assert of("none") == [(0, "높음", None, 0.0), (0, "보통", None, 0.0), (0, "낮음", None, 0.0), (1, None, "검출된 경고 없음", None)]
    assert of(None)[0] == (0, "높음", None, 1.0) and of(None)[3] == (1, "높음", "", None)
    rooms = spark.createDataFrame(
        [("d", 1, "site_total", "부지 1", 900.0, None), ("d", 2, "division", "과", None, 50.0), ("d", 3, "new", None, None, None)],
        "doc string, ord long, row_type string, name string, area double, subtotal_area double",
    )
    assert [(r.label, r.text, r.amount) for r in sheets.area_sheet(rooms, ["doc"]).orderBy("ord").collect()] == [("부지", "부지 1", 900.0), ("과", "      과", 50.0), ("세부", "        ", None)]
    needs = spark.createDataFrame([], "doc string, ord long, axis string, description string, weight double")
    parts = sheets.checklist(docs, scoring, needs, flags, rooms, ["doc"])
    upserts.export_sheets(parts, str(tmp_path))
    assert {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in parts} == {sheets.SCORING: 8, sheets.REQUIREMENTS: 0, sheets.WARNINGS: 16, sheets.AREAS: 3}


def test_predictions_and_patterns(spark, tmp_path):
    for path, text in {
        "truth/office/c_1/win_a_gt.json": '{"meta": {"facility_type": "school"}, "x": 1}', "truth/office/c_1/b_gt.json": '{"x": 2}', "truth/office/c_1/TEMPLATE_gt.json": "{}",
        "cache/c_1_win_a.json": '{"x": 3}', "cache/c_1_b.json": "{broken", "cache/deeper/c_1_b.json": '{"x": 4}',
        "db/_patterns/office.json": '{"n": 5}', "db/_patterns/hall.json": "{", "db/office/c/_meta.json": "{}",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    joined = readers.with_predictions(readers.truth_records(spark, f"{tmp_path}/truth"), readers.predicted_records(spark, f"{tmp_path}/cache"))
    got = {r.record_key: (r.t, r.p) for r in joined.select("record_key", F.try_variant_get("record", "$.x", "int").alias("t"), F.try_variant_get("predicted", "$.x", "int").alias("p")).collect()}
    assert got == {"c_1_win_a": (1, 3), "c_1_b": (2, None)}
    patterns = {r.facility_type: r.n for r in readers.all_patterns(spark, f"{tmp_path}/db").select("facility_type", F.expr("try_variant_get(pattern, '$.n', 'int') AS n")).collect()}
    assert patterns == {"office": 5, "hall": None}


def test_words_split_at_any_white_space(spark):
    from dossierlake.functions import text as T

    df = spark.createDataFrame([(" Aa\tb\x0bC\x0cd\r\ne  b\u00a0x ",), ("",), (None,), ("\t ",)], "s string")
    assert [r[0] for r in df.select(T.word_set("s")).collect()] == [["aa", "b", "c", "d", "e", "b\u00a0x"], [], [], []]


def test_check_lines_agrees_with_the_rules(spark):
    """Lines settled in one row, by the operators of the rules, and in a mix of both give what the rules give one by one."""
    rnd = random.Random(5)
    said = ["문 창 벽", "문\t창  벽 ", "창 벽 문 문", "문 창", "바닥", " ", None]
    texts = ["연구원 병원", "학교와 호텔", "공장", "배치", None]
    lines = [
        (d, rnd.choice([None, 1.0, 40.0, 60.0]), rnd.choice([None, 100.0]), rnd.choice([[], ["공유"], None]), rnd.choice([-1.0, 5.0, 30.0, None]), rnd.choice(["a", "b", None]),
         (d or 0) * 100 + i, rnd.choice(said), i, rnd.choice(texts), rnd.choice([0.2, 0.7, None]))
        for d in [*range(1, 30), None] for i in range(rnd.randint(0, 9))
    ]
    ddl = "doc int, points double, total_points double, shared_with array<string>, area double, axis string, idx int, description string, ord int, text string, confidence double"
    lines = spark.createDataFrame(lines, ddl)
    briefs = spark.createDataFrame(
        [(d, rnd.choice(["public", "residential", "industrial", "odd", None]), rnd.choice([0.0, 30.0, 60.0, None]), rnd.choice(["bid", None]), rnd.choice([True, None]), rnd.choice([1.0, None]), rnd.choice([2.0, None]))
         for d in range(35)],
        "doc int, facility_type string, stated_total double, genre string, has_scoring boolean, fa double, bc double",
    )
    facts = {"total_floor_area_sqm": ["fa"], "building_coverage_ratio_pct": ["bc"]}
    flags = conflicts.rule_flags(
        ["doc"], conflicts.points_check(lines, ["doc"]), similar.duplicate_sets(lines.dropna(subset=["axis"]), ["doc", "axis"]), conflicts.omissions(briefs, ["doc"], facts),
        conflicts.area_cross_check(lines, briefs.select("doc", "stated_total"), ["doc"]),
        conflicts.keyword_conflicts(lines.join(briefs.select("doc", "facility_type"), "doc"), ["doc"]), pages.low_confidence(lines),
    )
    wanted = sorted(map(tuple, conflicts.validate_briefs(briefs, flags, ["doc"]).collect()))
    assert len(wanted) == 35 and any(r[2] > 2 for r in wanted)
    for row_lines in (64, 4):
        got = conflicts.check_lines(lines, briefs, ["doc"], facts, row_lines=row_lines)
        assert sorted(map(tuple, got.collect())) == wanted, row_lines


def test_one_requirement_is_not_its_own_duplicate(spark):
    items = [("a", 1, "문 창"), ("a", 1, "문 창 벽"), ("a", 2, "창 문"), ("b", 3, "창 문")]
    df = spark.createDataFrame([(items,)], "l array<struct<axis:string,idx:int,description:string>>")
    assert df.select(similar.similar_within("l")).first()[0] == 2


def test_validate_briefs_exchanges_a_line_once(spark):
    plan = QUERIES["validate_briefs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation" in line]
    assert sum("l_orderkey" in line for line in reads) == 1 and len(reads) == 5
