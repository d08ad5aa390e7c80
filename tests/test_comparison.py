import pytest
from pyspark.sql import functions as F

from dossierlake.functions import labels
from dossierlake.functions import text as T
from dossierlake.operators import comparison, prose

GAPS = {
    "empty": ([], {"A": "win"}, "unknown"),
    "high": (["A", "B"], {"A": "win", "B": "lose"}, "high"),
    "low": (["B", "A"], {"A": "win"}, "low"),
    "partial": (["B", "A", "C"], {"A": "win", "B": "lose"}, "partial"),
    "low3": (["C", "B", "A"], {"A": "win"}, "low"),
    "contracted": (["A", "B"], {"A": "contracted", "B": "lose"}, "high"),
}


def test_gap_analysis(spark):
    ranking = spark.createDataFrame(
        [(k, c, i + 1) for k, (r, _, _) in GAPS.items() for i, c in enumerate(r)], "k string, company string, pos int"
    )
    results = spark.createDataFrame(
        [(k, c, v) for k, (_, res, _) in GAPS.items() for c, v in res.items()], "k string, company string, result string"
    )
    got = {r.k: r.alignment for r in comparison.gap_analysis(ranking, results, ["k"]).collect()}
    assert got == {k: v for k, (_, _, v) in GAPS.items()}


@pytest.mark.parametrize(
    "raw,expected",
    [("b2", (-2, "B2")), ("지하 3층", (-3, "B3")), ("12F", (12, "12F")), ("지상 4", (4, "4F")), ("3층", (3, "3F")),
     ("옥상", (10000, "ROOF")), ("PH1", (10000, "ROOF")), ("250F", (250, "250F")), ("로비", (None, None))],
)
def test_floors(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "f string").withColumn("o", labels.floor_order("f"))
    row = df.select("o", labels.floor_label("o").alias("l")).first()
    assert (row.o, row.l) == expected


def test_programme_category(spark):
    df = spark.createDataFrame([("지하주차장 도서관",), ("F&B 카페",), ("unit a",), ("xyz",)], "p string")
    assert [r[0] for r in df.select(labels.programme_category("p")).collect()] == ["core", "commerce", "residence", "other"]


def test_grades(spark):
    df = spark.createDataFrame(
        [("A", None), ("상", None), ("", 8.5), ("x", 6.9), (None, 2.0), (None, None)], "g string, s double"
    )
    assert [r[0] for r in df.select(labels.resolve_grade("g", "s")).collect()] == ["A", "B", "A", "C", "E", None]


def test_text_helpers(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.plain_number(F.lit("1,440"))) == "1440"
    assert pick(T.plain_number(F.lit("30.0"))) == "30"
    assert pick(T.plain_number(F.lit("18.30"))) == "18.3"
    assert pick(T.plain_number(F.lit("007"))) == "7"
    assert pick(T.plain_number(F.lit("100"))) == "100"
    assert pick(T.bigram_set(F.lit("a"))) == ["a"]
    assert pick(T.bigram_set(F.lit(""))) == []
    assert pick(T.overlapping_count(F.lit("aaaa"), "aa")) == 3
    assert pick(T.file_date(F.lit("260713_지침.pdf"))) == "20260713"
    assert pick(T.file_date(F.lit("v1234567.pdf"))) == ""
    assert pick(T.strip_grade_tail(F.lit("동선이 명확하여 B 수준 (p.3)"))).startswith("동선이 명확하")
    assert pick(T.strip_grade_tail(F.lit("B 수준(p.2)에 그침"))) == "B 수준(p.2)에 그침"
    assert pick(T.legal_date(F.lit("2026071"))) == ""
    assert pick(labels.anonymous_label(F.lit(27))) == "안27"
    assert pick(labels.effective_label(F.lit(""), F.lit("20260713"))) == "법규 시행 2026-07-13"


def test_differentiators(spark):
    lines = spark.createDataFrame(
        [("컨셉: 당선작은 a — 이유",), ("당선작은 전략: b",), ("축 하나: x - y",)], "text string"
    )
    got = [(r.axis, r.body, r.insight) for r in prose.differentiator_parts(lines).collect()]
    assert got == [("컨셉", "당선작은 a", "이유"), ("", "당선작은 전략: b", ""), ("축 하나", "x - y", "")]


def test_lock_alternatives(spark):
    base = spark.createDataFrame([("d", 1, "로비", "중앙", "1F", True), ("d", 2, "강당", "북", "2F", False)], "doc string, ord int, program string, plan string, level string, required boolean")
    alts = spark.createDataFrame(
        [("d", 1, 1, "로비", "서", "3F", None), ("d", 2, 1, "카페", "동", "1F", None), ("d", 3, 1, "로비", "서", "3F", None)],
        "doc string, alt int, ord int, program string, plan string, level string, required boolean",
    )
    got = {(r.alt, r.program, r.plan, r.level, r.required, r.added) for r in comparison.lock_alternatives(base, alts, ["doc"], keep=2).collect()}
    assert got == {(1, "로비", "중앙", "1F", True, False), (2, "카페", "동", "1F", False, False), (2, "로비", "중앙", "1F", True, True)}
