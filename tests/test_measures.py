import pytest
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.operators import measures, patterns

SCHEMA = "doc_id string, " + ", ".join(f"{m} double" for m in fixed.MEASURES)


def quant(spark, **cases):
    rows = [tuple([k] + [float(v[m]) if m in v else None for m in fixed.MEASURES]) for k, v in cases.items()]
    return spark.createDataFrame(rows, SCHEMA)


def short(**v):
    names = {
        "tfa": "total_floor_area_sqm", "above": "area_above_ground_sqm", "site": "site_area_sqm",
        "bldg": "building_area_sqm", "cov": "building_coverage_ratio_pct", "far": "floor_area_ratio_pct",
        "up": "floors_above", "down": "floors_below", "park": "parking_count",
    }
    return {names[k]: x for k, x in v.items()}


DOUBLE = short(tfa=29341.01, site=130924.5, bldg=106850, cov=27.46, far=327.89, up=45, park=6895)

CASES = {
    "tower": (short(tfa=58817.45, site=7498, bldg=4131.36, cov=55.1, far=455.51, up=20, down=5, park=430), set()),
    "known": (short(tfa=181982.08, above=129505.66, site=56401, bldg=6061.89, cov=10.75, far=229.62, up=29, down=2, park=1738), set()),
    "double": (DOUBLE, {"coverage_mismatch", "floor_area_below_far_implied"}),
    "small": (short(tfa=67971, site=69628, far=449.38), {"floor_area_below_far_implied"}),
    "big": (short(site=1000, bldg=1500), {"building_gt_site"}),
    "cov20": (short(site=1000, bldg=500, cov=20), {"coverage_mismatch"}),
    "cov50": (short(site=1000, bldg=500, cov=50), set()),
    "cov150": (short(cov=150), {"out_of_bounds"}),
    "up200": (short(up=200), {"out_of_bounds"}),
    "down30": (short(down=30), {"out_of_bounds"}),
    "warn": (short(site=1000, bldg=600, cov=60, far=50), {"coverage_gt_far"}),
    "far": (short(site=1000, above=1000, far=300), {"far_above_ground_mismatch"}),
    "zero": (short(site=0, bldg=500, cov=20, far=100), set()),
}


def test_flags(spark):
    df = quant(spark, **{k: v for k, (v, _) in CASES.items()})
    got = {}
    for r in measures.measure_flags(df, ["doc_id"]).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    for name, (_, expected) in CASES.items():
        assert got.get(name, set()) == expected, name


def test_clean_values_drop_flagged_fields(spark):
    got = measures.clean_values(quant(spark, d=DOUBLE), ["doc_id"]).collect()
    assert {(r.field, r.value) for r in got} == {("floors_above", 45.0), ("parking_count", 6895.0)}


def test_stored_flags_win(spark):
    df = quant(spark, good=short(cov=50, site=1000), bad=short(cov=20, bldg=500, site=1000))
    flags = F.when(
        F.col("doc_id") == "bad",
        F.expr("array(named_struct('rule','x','severity','error','fields',array('building_coverage_ratio_pct','building_area_sqm','site_area_sqm'),'stated',cast(null as double),'expected',cast(null as double)))"),
    ).otherwise(F.expr(f"cast(array() as {measures.FLAG_TYPE})"))
    values = measures.clean_values(df.withColumn("flags", flags), ["doc_id"], stored_flags="flags")
    stats = {r.field: r for r in measures.grouped_stats(values, ["field"]).collect()}
    assert stats["building_coverage_ratio_pct"].n == 1 and stats["building_coverage_ratio_pct"]["mean"] == 50
    assert stats["site_area_sqm"].n == 1 and stats["site_area_sqm"]["std"] == 0.0
    assert "building_area_sqm" not in stats


def test_empty_stored_flags_keep_everything(spark):
    df = quant(spark, d=DOUBLE).withColumn("flags", F.expr(f"cast(array() as {measures.FLAG_TYPE})"))
    assert measures.clean_values(df, ["doc_id"], stored_flags="flags").count() == 7


def test_recommended_range(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0, "lose"), ("a", "x", 5.0, "win"), ("b", "x", 2.0, "lose"), ("b", "x", 3.0, "lose")],
        "c string, field string, value double, result string",
    )
    got = {r.c: (r.low, r.high, r.single) for r in measures.recommended_range(df, ["c", "field"]).collect()}
    assert got == {"a": (5.0, 5.0, True), "b": (2.0, 3.0, False)}


def test_losers_only_facility_has_no_pattern(spark):
    subs = spark.createDataFrame([("f", "lose", "d1"), ("g", "win", "d2"), ("g", "lose", "d3")], "facility_type string, cohort string, doc_id string")
    q = quant(spark, d1=short(up=3), d2=short(up=4), d3=short(up=5)).join(subs, "doc_id")
    pages = subs.select("*", F.lit("COVER").alias("primary_type"), F.lit(2).alias("pages"), F.lit(8).alias("total_pages"))
    kw = subs.select("*", F.lit("light").alias("keyword"))
    mass = subs.select("*", F.lit("tower").alias("mass_type"))
    out = patterns.facility_pattern(subs, pages, q, kw, mass).collect()
    assert {r.facility_type for r in out} == {"g"}
    assert {r.cohort for r in out if r.family == "mass_types"} == {"win"}
    assert {(r.key, r["mean"]) for r in out if r.family == "page_distribution" and r.cohort == "win"} == {("COVER", 2.0), ("COVER_ratio", 0.25)}


def test_half_even(spark):
    from dossierlake.functions.numbers import half_even

    assert spark.range(1).select(half_even(F.lit(0.125), 2)).first()[0] == pytest.approx(0.12)
    assert spark.range(1).select(half_even(F.lit(2.5), 0)).first()[0] == 2.0
