import random

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import areas, blocks, scan, scoring, sites


def cells(spark, grid, spans=()):
    marks = {(r, c): n for r, c, n in spans}
    rows = [("t", r, c, text, marks.get((r, c), 1)) for r, line in enumerate(grid) for c, text in enumerate(line)]
    return spark.createDataFrame(rows, "doc string, row int, col int, text string, rowspan int")


@pytest.mark.parametrize("hot", [False, True])
def test_scoring_table(spark, hot):
    grid = [["구분", "평가 항목", "배점", "점수 계산 방법"], ["배치", "동선", "30", "99"], ["공간", "조닝", "", "99"], ["기술", "구조", "○40", "99"],
            ["기술2", "설비", "0.3", "99"], ["합 계", "", "100", ""]]
    df = cells(spark, grid, [(1, 2, 2)])
    rows = {r.row: r for r in scoring.scoring_rows(df, ["doc"], hot=hot).collect()}
    assert (rows[1].name, rows[1].points, rows[1].shared_with, rows[1].sub_items) == ("배치", 30.0, ["공간"], ["동선", "조닝"])
    assert rows[3].points == 40.0 and rows[4].points == 30.0 and rows[5].is_subtotal and 2 not in rows
    total = scoring.scoring_totals(scoring.scoring_rows(df, ["doc"], hot=hot), ["doc"]).first()
    assert total.total_points == 100.0 and total.categories == 3


def test_scoring_table_without_points_column(spark):
    assert scoring.scoring_rows(cells(spark, [["구분", "방법"], ["a", "1"]]), ["doc"]).isEmpty()


def test_merged_name_makes_a_category_per_row(spark):
    df = cells(spark, [["구분", "내용", "배점"], ["개발", "가", "10"], ["", "나", "5"]], [(1, 0, 2)])
    got = [(r.row, r.name, r.points) for r in scoring.scoring_rows(df, ["doc"]).orderBy("row").collect()]
    assert got == [(1, "개발", 10.0), (2, "개발", 5.0)]


def test_scoring_focus(spark):
    rows = [("d", 1, 1, "x", 5.0, [], None), ("d", 2, 1, "a", 50.0, [], 100.0), ("d", 2, 2, "b", 40.0, [], 100.0), ("d", 2, 3, "c", None, ["a"], 100.0), ("d", 2, 4, "", None, [], 100.0)]
    df = spark.createDataFrame(rows, "doc string, page int, ord int, name string, points double, shared_with array<string>, total_points double").withColumn("sub_items", F.array())
    got = {r.ord: (r.category, r.weight_pct, r.is_qualitative, r["rank"]) for r in scoring.scoring_focus(df, ["doc"]).collect()}
    assert got == {1: ("a", 50.0, False, 1), 2: ("b", 40.0, False, 2), 3: ("c", None, False, None), 4: ("항목4", None, True, None)}


def test_bands(spark):
    text = "사업수행능력평가 (8만㎡ 미만: 20%, 8만~24만㎡: 30%, 24만㎡ 이상: 40%)"
    df = spark.createDataFrame([("d", 1, 1, text)], "doc string, source_rank int, ord int, text string")
    bands = scoring.text_bands(df, ["doc"])
    assert {(r.min_sqm, r.max_sqm, r.weight_pct) for r in bands.collect()} == {(None, 80000.0, 20.0), (80000.0, 240000.0, 30.0), (240000.0, None, 40.0)}
    for value, weight in ((79999.0, 20.0), (80000.0, 30.0), (240000.0, 40.0)):
        values = spark.createDataFrame([("d", value)], "doc string, value double")
        assert scoring.band_lookup(values, scoring.preferred_bands(bands, ["doc"]), ["doc"]).first().weight_pct == weight
    nothing = spark.createDataFrame([("d", None)], "doc string, value double")
    assert scoring.band_lookup(nothing, bands, ["doc"]).isEmpty()
    assert {r[0] for r in scoring.band_thresholds(bands, ["doc"]).select("threshold_sqm").collect()} == {80000.0, 240000.0}


AREA = "doc string, ord int, row_type string, name string, area string, subtotal_area string"


@pytest.mark.parametrize("hot", [False, True])
def test_site_blocks_stop_at_the_declared_total(spark, hot):
    rows = [("site_total", "부지1", None, "100"), ("facility", "구청", None, "60"), ("facility", "부속 주차장(지하)", None, "40"), ("facility", "재집계", None, "999"),
            ("site_total", "부지2", "50", None), ("facility", "의회", "30 ㎡", None), ("space", "방", "5", None), ("facility", "늦은", None, "7"),
            ("site_total", "총합계", None, "150"), ("facility", "밖", None, "99999")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], AREA)
    got = {(r.site, r.name, r.area) for r in areas.site_facilities(df, ["doc"], hot=hot).collect()}
    assert got == {(0, "구청", 60.0), (0, "부속 주차장(지하)", 40.0), (4, "의회", 30.0)}


@pytest.mark.parametrize("hot", [False, True])
def test_small_blocks_are_collected(spark, hot):
    rows = [("d", i, "facility", f"· f{i}", str(100 - i), None) for i in range(20)] + [("d", 99, "facility", "소 계", "5000", None)]
    got = areas.programme_blocks(spark.createDataFrame(rows, AREA), ["doc"], hot=hot, most=14).collect()
    assert len(got) == 14 and areas.programme_blocks(spark.createDataFrame(rows, AREA), ["doc"], hot=hot).count() == 20
    last = next(r for r in got if r["rank"] == 14)
    assert last.name == "기타 7개" and last.area == sum(100 - i for i in range(13, 20)) and last.total == sum(100 - i for i in range(20))


def test_facility_sum_of_spaces(spark):
    rows = [("space", "앞", "3", None), ("facility", "a", None, None), ("space", "x", "10", None), ("space", "y", "20", None), ("bureau", "z", "99", None), ("facility", "b", None, "7")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], AREA)
    assert {(r.name, r.area) for r in areas.facility_totals(df, ["doc"]).collect()} == {("앞", 3.0), ("a", 30.0), ("b", 7.0)}


def test_envelope(spark):
    limits = spark.createDataFrame([("d", 1, 1000.0, 50.0, 400.0, 21.5)], "doc string, ord int, area double, bcr double, far double, h_limit double")
    buckets = spark.createDataFrame([("d", 5, "청사", 2000.0), ("d", 5, "지하 주차", 500.0), ("d", 5, "합계", 9.0)], "doc string, ord int, name string, area double")
    r = areas.site_envelopes(limits, buckets, ["doc"]).first()
    assert (r.footprint, r.floors, r.binding, r.cap, r.ground_est, r.under_sum) == (500.0, 5.0, "높이한도", 2500.0, 2000.0, 500.0)


def test_site_texts(spark):
    df = spark.createDataFrame([("제2종일반주거지역",), ("제3종일반주거지역 (제2종일반주거지역에서 종상향)",), ("미정",), ("",)], "z string")
    assert [tuple(r) for r in df.select(sites.zone_use("z"), sites.zone_use_raw("z")).collect()] == [
        ("제2종일반주거지역", None), (None, "제3종일반주거지역 (제2종일반주거지역에서 종상향)"), (None, "미정"), (None, None)]
    statements = spark.createDataFrame(
        [("d", 1, "'부지1' 및 '부지2' 부설주차장으로 1,430대 확보"), ("d", 2, "부지2에 99대 설치"), ("d", 3, "기존 50대 운영"), ("d", 4, "총 500대 이상")], "doc string, ord int, text string")
    got = {r.site_id: r.required_parking_count for r in sites.parking_by_site(statements, ["doc"]).collect()}
    assert got == {"부지2": 1430}
    assert sites.parking_generic(statements, ["doc"]).first().generic_note == "총 500대 이상"
    addresses = spark.createDataFrame([("d", 1, "서울특별시 영등포구 당산동 3가 (부지1), 385 (부지2)"), ("d", 2, "다른 (부지1)")], "doc string, ord int, address string")
    got = {r.site_id: r.address for r in sites.site_addresses(addresses, ["doc"]).collect()}
    assert got == {"부지1": "서울특별시 영등포구 당산동 3가", "부지2": "서울특별시 영등포구 385"}


def elements(spark, lines):
    rows = [("d", i, "table" if t.startswith("|") else "paragraph", t, h) for i, (t, h) in enumerate(lines)]
    return spark.createDataFrame(rows, "doc string, ord int, kind string, text string, is_heading boolean")


def test_blocks(spark):
    lines = [("제1장 개요", True), ("1.1 목적 ", False), ("본문", False), ("|표|", False), ("뒤", False), ("목차\t3", False), ("둘\t4", False), ("", False), ("[표 1] 면적", False), ("끝 2. ", False), ("제2장 끝", True)]
    got = [(r.block_num, r.header_text, r.paragraphs, r.has_table, r.is_toc) for r in blocks.document_blocks(elements(spark, lines), ["doc"]).orderBy("block_num").collect()]
    # the lone chapter heading leads the header of the next block, the last one stands alone
    assert got == [
        (1, "제1장 개요 > 표" if False else "제1장 개요 > |표|", 2, True, False),
        (2, "뒤", 1, False, False),
        (3, "(목차)", 2, False, True),
        (4, "[표 1] 면적", 2, False, False),
        (5, "제2장 끝", 0, False, False),
    ]


def test_forced_cut(spark):
    lines = [("제1장 시작", True)] + [(f"문단 {i}", False) for i in range(130)]
    got = [r.paragraphs for r in blocks.document_blocks(elements(spark, lines), ["doc"]).orderBy("block_num").collect()]
    assert got == [60, 60, 11]
    long = [("x" * 7000, False)] * 4
    assert [r.paragraphs for r in blocks.document_blocks(elements(spark, long), ["doc"]).orderBy("block_num").collect()] == [2, 2]


def cut_one_by_one(sizes):
    """Cut number of every element (size, is a paragraph) of a segment, read in order."""
    out, cut, n, chars = [], 0, 0, 0
    for size, para in sizes:
        out.append(cut)
        if para:
            first = n == 0 and cut == 0
            n, chars = n + 1, chars + size
            if (n >= 60 or chars >= 12000) and not first:
                cut, n, chars = cut + 1, 0, 0
    return out


@pytest.mark.parametrize("hot,levels", [(0, 0), (0, 2), (2000, 2)])
def test_forced_cuts_follow_tables_of_slices(spark, monkeypatch, hot, levels):
    draw = random.Random(7)
    monkeypatch.setattr(blocks, "CUT_SLICE", 64)
    monkeypatch.setattr(scan, "GROUP_LIMIT", 500 if hot else scan.GROUP_LIMIT)
    shapes = {
        "long": [(draw.choice([0, 5, 150, 900, 4000, 13000]), draw.random() < 0.95) for _ in range(9000)],
        "even": [(1, True)] * 6000, "huge first": [(20000, True)] * 300, "exact": [(200, True)] * 128 + [(5, False)],
        "short": [(10, True)] * 59, "table": [(30000, False)], "tables": [(30000, False)] * 70, "sixty": [(1, True)] * 60 + [(1, False)],
        None: [(300, True)] * 500,
    }
    rows = [(d, 1, i, "paragraph" if p else "table", "x" * n, d == "toc") for d, e in shapes.items() for i, (n, p) in enumerate(e)]
    rows += [("toc", 1, i, "paragraph", "x", True) for i in range(300)]
    found = blocks.forced_cuts(spark.createDataFrame(rows, "doc string, segment long, ord int, kind string, text string, is_toc boolean"), ["doc"], hot, levels)
    got = {}
    for r in found.select("doc", "ord", "cut").orderBy("ord").collect():
        got.setdefault(r.doc, []).append(r.cut)
    assert got.pop("toc") == [0] * 300
    assert got == {d: cut_one_by_one(e) for d, e in shapes.items()}
    assert max(got["long"]) > 1000


def test_headers_and_source_text_are_whole(spark):
    from pyspark.sql import functions as F

    chapter, section, body = "제1장 " + "가" * 100, "1.1 " + "나" * 150, "다" * 9000
    lines = elements(spark, [(chapter, True), (section, True), (body, False)])
    got = blocks.document_blocks(lines, ["doc"]).orderBy("block_num").collect()
    assert [r.header_text for r in got] == [f"{chapter} > {section}"]
    assert [r.header_text for r in blocks.document_blocks(lines, ["doc"], header_max=60, trail_max=120).collect()] == [f"{chapter[:60]} > {section[:60]}"[:120]]
    flat = blocks.document_blocks(lines, ["doc"], tables_alone=True).orderBy("block_num").collect()
    assert [r.header_text for r in flat] == [chapter, section]
    one = spark.range(1).select(F.lit("h").alias("h"), F.array(F.lit(body)).alias("p"), F.lit("").alias("t"))
    whole = "[HEADER] h\n\n[PARAGRAPHS]\n\n" + body
    assert one.select(blocks.source_text("h", "p", "t")).first()[0] == whole
    assert one.select(blocks.source_text("h", "p", "t", ends=(4000, 2000))).first()[0] == whole[:4000] + "\n\n[...생략...]\n\n" + whole[-2000:]


def test_grid(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b<br>c</td></tr><tr><td>d</td><td rowspan=3>e</td></tr><tr><td>f</td><td>g&amp;</td></tr><tr></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page int, html string")
    grid = blocks.cell_grid(blocks.html_cells(pages, ["page"]), ["page", "table_no"])
    got = {(r.row, r.col): r.text for r in grid.collect()}
    assert got == {(0, 0): "a", (0, 1): "b c", (0, 2): "b c", (1, 0): "", (1, 1): "d", (1, 2): "e", (2, 0): "f", (2, 1): "g&", (2, 2): ""}
    assert {(r.row, r.col, r.merged_rows) for r in blocks.merge_list(grid, ["page", "table_no"]).collect()} == {(0, 0, 2), (1, 2, 3)}


def test_grid_of_a_wide_span(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=999999999>w</td></tr><tr><td>x</td><td>y</td></tr></table>"
    cells = blocks.html_cells(spark.createDataFrame([(1, html)], "page int, html string"), ["page"])
    grid = blocks.cell_grid(cells, ["page", "table_no"], max_colspan=1000)
    got = {(r.row, r.col): r.text for r in grid.collect()}
    assert len(got) == 1 + 1000 + 3 and got[0, 1000] == "w" and got[1, 0] == "" and got[1, 2] == "y"
    assert "Python" not in grid._jdf.queryExecution().executedPlan().toString()


def brute_grid(cells):
    """row -> [(seq, text, rowspan, colspan)] to (row, col, text, rowspan), cell by cell."""
    out, open_spans, until = [], {}, None
    for row in range(max(cells) + 1):
        units = [(t, rs) for _, t, rs, cs in sorted(cells.get(row, [])) for _ in range(cs)]
        free = [c for c in range(len(units) + len(open_spans) + 1) if c not in open_spans]
        placed = list(zip(free, units))
        until = free[len(units)]
        out += [(row, c, t, rs) for c, (t, rs) in placed] + [(row, c, "", 1) for c in open_spans if c < until]
        going = {c: left - (c < until) for c, left in open_spans.items()}
        going.update({c: rs - 1 for c, (_, rs) in placed})
        open_spans = {c: left for c, left in going.items() if left > 0}
    return sorted(out)


def test_grids_of_any_length(spark, monkeypatch):
    """Folds in blocks of any size, rows without cells, spans over them and wide ones."""
    import random

    rng = random.Random(3)
    tables = {}
    for t in range(12):
        rows = sorted(rng.sample(range(60), rng.randint(1, 40)))
        tables[t] = {r: [(i, f"{r}.{i}", rng.choice([1, 1, 1, 2, 5, 40]), rng.choice([1, 1, 2, 6])) for i in range(rng.randint(1, 4))] for r in rows}
    tables[12] = {0: [(0, "w", 2, 5000)], 1: [(0, "x", 1, 1)]}
    flat = [(t, r, *c) for t, rows in tables.items() for r, cells in rows.items() for c in cells]
    cells = spark.createDataFrame(flat, "t int, row int, seq int, text string, rowspan int, colspan int")
    for folded in (1, 7, 128):
        monkeypatch.setattr(blocks, "FOLDED", folded)
        got = {}
        for r in blocks.cell_grid(cells, ["t"]).collect():
            got.setdefault(r.t, []).append((r.row, r.col, r.text, r.rowspan))
        assert {t: sorted(g) for t, g in got.items()} == {t: brute_grid(c) for t, c in tables.items()}


def test_long_grids_take_linear_work(spark):
    import time

    def seconds(n):
        cells = spark.range(n).select(F.lit(1).alias("t"), F.col("id").alias("row"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("seq")).select(
            "t", "row", "seq", F.col("row").cast("string").alias("text"), F.when(F.col("row") % 7 == 0, 3).otherwise(1).alias("rowspan"), F.lit(1).alias("colspan")
        )
        start = time.perf_counter()
        assert blocks.cell_grid(cells, ["t"]).agg(F.countDistinct("row")).first()[0] == n
        return time.perf_counter() - start

    seconds(500)
    short, long = seconds(5000), seconds(40_000)
    assert long < 20 * short + 5


def test_cells_with_and_without_attributes(spark):
    """Cells that hold no markup, reference or span pass unchanged; stated ones are read as before."""
    html = "<table><tr><td> a  b </td><TD class=x>c</TD><th rowspan = '3' colspan=0>d<br/>e</th><td colspan=2>&lt;f&gt;</td><td rowspan=x></td></tr><tr></tr></table>"
    cells = blocks.html_cells(spark.createDataFrame([(1, html)], "page int, html string"), ["page"]).orderBy("row", "seq").collect()
    assert [(r.row, r.seq, r.text, r.rowspan, r.colspan) for r in cells] == [
        (0, 0, "a b", 1, 1), (0, 1, "c", 1, 1), (0, 2, "d e", 3, 1), (0, 3, "<f>", 1, 2), (0, 4, "", 1, 1), (1, None, None, 1, 1),
    ]


def test_scoring_table_stays_with_its_order(spark):
    """Lines are exchanged once, by order; what follows needs no other exchange."""
    from dossierlake.plans.catalogue import QUERIES

    plan = QUERIES["scoring_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_points_are_the_first_number(spark):
    df = cells(spark, [["구분", "평가 항목", "배점"], ["가\n나", "x", "약 1 (2)"], ["다", "y", "0.25점"], ["라", "", "없음"], ["", "", "7"], [" ", "", " "]])
    got = [(r.row, r.name, r.points, r.shared_with, r.sub_items) for r in scoring.scoring_rows(df, ["doc"]).orderBy("row").collect()]
    assert got == [(1, "가 나", 100.0, [], ["x"]), (2, "다", 25.0, [], ["y"]), (3, "라", None, [], [])]
