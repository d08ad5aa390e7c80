import json
import math
import os

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import geo
from dossierlake.operators import evaluation, search
from dossierlake.sources import readers, upserts
from dossierlake.streaming import refresh

DOCS = [("1", "aaaa stadium", "x"), ("2", "park", "aa stadium stadium"), ("3", "nothing", "here"), ("4", "AAA", ""), ("5", "other text", "more")]
WEIGHTS = {"title": 2.0, "body": 1.0}


def _count(text, phrase):
    return sum(text.startswith(phrase, i) for i in range(len(text)))


def _bm25(phrases):
    rows = [(k, [(t.lower(), WEIGHTS["title"]), (b.lower(), WEIGHTS["body"])]) for k, t, b in DOCS]
    length = {k: sum(max(len(t) - 2, 0) for t, _ in cols) for k, cols in rows}
    mean = sum(length.values()) / len(rows)
    out = {}
    for p in phrases:
        hits = {k: sum(w * _count(t, p) for t, w in cols) for k, cols in rows}
        n = sum(v > 0 for v in hits.values())
        idf = math.log((len(rows) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, f in hits.items():
            if f > 0:
                out[k] = out.get(k, 0.0) - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[k] / mean))
    return out


def test_bm25_counts_overlaps(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    for phrases in (["aaa"], ["stadium"], ["aaa", "stadium", "ab"]):
        got = {r.id: r.score for r in search.bm25(docs, "id", phrases, WEIGHTS).collect()}
        expected = _bm25([p for p in phrases if len(p) >= 3])
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert search.bm25(docs, "id", ["aa"], WEIGHTS).isEmpty()
    assert [r.id for r in search.search(docs, "id", ["stadium"], WEIGHTS, limit=1).collect()] == ["1"]


def test_postings_hold_every_match(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    index = search.postings(docs, "id", ["title", "body"])
    hits = {r.id for r in search.phrase_candidates(index, "Stadium", "id").collect()}
    assert hits == {r.id for r in search.phrase_matches(docs, "Stadium", ["title", "body"]).collect()} == {"1", "2"}


def test_values_and_categories(spark):
    truth = spark.createDataFrame(
        [("s", "site_area_sqm", 1000.0, None), ("s", "floors_above", 5.0, None), ("s", "parking_count", None, False), ("s", "floor_area_ratio_pct", 0.0, True)],
        "sample string, field string, truth double, present boolean",
    )
    pred = spark.createDataFrame([("s", "site_area_sqm", 1009.0), ("s", "floors_above", 6.0), ("s", "parking_count", 3.0), ("s", "floor_area_ratio_pct", 0.4)], "sample string, field string, pred double")
    got = {r.field: r for r in evaluation.compare_values(truth, pred, ["sample"]).collect()}
    assert got["site_area_sqm"].match and not got["floors_above"].match
    assert got["parking_count"].match is None and got["parking_count"].fp and not got["parking_count"].completion
    assert got["floor_area_ratio_pct"].match and math.isinf(got["floor_area_ratio_pct"].rel_err)
    t = spark.createDataFrame([("structure_system", "철근콘크리트조"), ("zoning", "준 공업"), ("certification", "ZEB, 녹색"), ("mass_type", "tower")], "field string, truth string").withColumn("k", F.lit(1))
    p = spark.createDataFrame([("structure_system", "RC"), ("zoning", "준공업"), ("certification", "녹색/ZEB")], "field string, pred string").withColumn("k", F.lit(1))
    got = {r.field: (r.match, r.similarity) for r in evaluation.compare_categories(t, p, ["k"]).collect()}
    assert got == {"structure_system": (True, 1.0), "zoning": (True, 1.0), "certification": (True, 1.0), "mass_type": (None, None)}


def test_tiles_and_rings(spark):
    df = spark.createDataFrame([(37.5, 127.0)], "lat double, lng double")
    r = df.select(geo.tile_x("lng", 16).alias("x"), geo.tile_y("lat", 16).alias("y"), geo.metre_x("lng").alias("mx"), geo.metre_y("lat").alias("my")).first()
    n = 2**16
    assert r.x == int((127.0 + 180) / 360 * n)
    assert r.y == int((1 - math.log(math.tan(math.radians(37.5)) + 1 / math.cos(math.radians(37.5))) / math.pi) / 2 * n)
    assert abs(r.mx - 127.0 * 20037508.342789244 / 180) < 1e-6
    rings = spark.sql("select 'MultiPolygon' k, cast(null as array<array<struct<lng:double,lat:double>>>) p, array(array(array(struct(1D as lng, 2D as lat)), array(struct(9D as lng, 9D as lat)))) m")
    assert len(rings.select(geo.outer_rings("k", "p", "m").alias("r")).first().r) == 1


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False))


def test_record_tree(spark, tmp_path):
    root = str(tmp_path / "db")
    _write(f"{root}/public/c1/_meta.json", {"competition_id": "c1", "competition_name": "청사", "tags": ["a"]})
    _write(f"{root}/public/c1/_report.html", "<html>")
    _write(f"{root}/public/c1/_comparison.json", {"blind_ranking": ["A"]})
    _write(f"{root}/office/c2/_meta.json", "{broken")
    _write(f"{root}/office/c3/_meta.json", {"competition_id": "c3"})
    _write(f"{root}/public/c1/submissions/A_win.json", {"company": "A", "total_pages": 3, "page_distribution": {"COVER": 1}, "extracted_data": {"x": 1}})
    _write(f"{root}/public/c1/submissions/A_deep.json", {"deep": {}})
    _write(f"{root}/public/c1/submissions/B_lose.json", {"company": "B", "result": "lose"})
    projects = readers.scan_projects(spark, root)
    got = {(r.facility_type, r.competition_id, r.report_available) for r in projects.collect()}
    assert got == {("public", "c1", True), ("office", "c3", False)}
    assert readers.quarantine(readers.scan_records(spark, root, "_meta.json")).first().corrupt == "{broken"
    subs = readers.scan_submissions(spark, root)
    assert {(r.company, r.result, r.competition_id) for r in subs.collect()} == {("A", "win", "c1"), ("B", "lose", "c1")}
    assert readers.winners(subs).count() == 1 and readers.losers(subs).count() == 1
    comps = readers.scan_comparisons(spark, root, projects)
    assert {(r.competition_id, r.comparison is None) for r in comps.collect()} == {("c1", False), ("c3", True)}
    briefs = str(tmp_path / "briefs")
    _write(f"{briefs}/b1.json", {"_brief_meta": {"brief_name": "x"}, "_insight": {"a": 1}, "_quantitative": {}, "_contradictions": []})
    _write(f"{briefs}/b2.json", {"feasibility_export": {"sites": [{"address": "서울"}]}, "_insight": {}})
    _write(f"{briefs}/b1.md", "x")
    _write(f"{briefs}/b2_proposal.html", "x")
    rows = readers.list_briefs(spark, briefs).collect()
    assert [(r.brief_id, r.has_insight, r.has_md, r.has_proposal, r.site_address, r.brief_genre) for r in rows] == [
        ("b2", False, False, True, "서울", "unknown"), ("b1", True, True, False, "", "unknown")]
    summary = {r.brief_id: r for r in readers.brief_summary(readers.readable(readers.scan_records(spark, briefs, "*.json"))).collect()}
    assert summary["b1"].has.insight and not summary["b1"].has.proposal and summary["b1"].contradictions is None


def test_salvage(spark):
    texts = ['{"a":1}', '```json\n{"a":1}\n```', 'x {"a":1,} y', "[1,2,]", "nope", '```\n[{"a":1}]\n``` tail']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.j for r in readers.salvage_json(df).select("i", F.to_json("record").alias("j")).collect()}
    assert got == {0: '{"a":1}', 1: '{"a":1}', 2: '{"a":1}', 3: "[1,2]", 4: None, 5: '[{"a":1}]'}


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a", "t", "2020"), (2, "b", "", "2021")], "id int, name string, tags string, created_at string")
    new = spark.createDataFrame([(1, "A", "", "now"), (3, "c", "z", "now")], "id int, name string, tags string, created_at string")
    got = {tuple(r) for r in upserts.upsert_projects(old, new, ["id"], ["tags"]).collect()}
    assert got == {(1, "A", "t", "2020"), (2, "b", "", "2021"), (3, "c", "z", "now")}
    extra = spark.createDataFrame([(1, "x"), (2, "y")], "id int, tags string")
    assert {(r.id, r.tags) for r in upserts.enrich_projects(old, extra, ["id"], ["tags"]).collect()} == {(1, "t"), (2, "y")}


SUBS = "facility_type string, id int, result string"
CHANGE = SUBS + ", op string, seq int"


def _counts(df):
    return df.groupBy("facility_type").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "win").alias("wins"))


def test_stream_refreshes_only_touched_facilities(spark, tmp_path):
    silver, target, landing, ck = (str(tmp_path / n) for n in ("silver", "target", "landing", "ck"))
    rows = [("a", 1, "win"), ("a", 2, "lose"), ("b", 3, "win"), ("c", 4, "win")]
    upserts.write_partitions(spark.createDataFrame(rows, SUBS), silver)
    upserts.write_partitions(_counts(spark.read.parquet(silver)), target)
    untouched = {f: os.path.getmtime(f"{target}/facility_type=c/{f}") for f in os.listdir(f"{target}/facility_type=c")}
    changes = [("a", 2, "lose", "upsert", 1), ("a", 2, "win", "upsert", 2), ("b", 3, None, "delete", 3), ("a", 9, "lose", "upsert", 4)]
    spark.createDataFrame(changes, CHANGE).write.parquet(landing)
    for _ in range(2):  # a second run finds nothing new
        refresh.start_refresh(spark, landing, CHANGE, silver, target, ck, ["id"], _counts).awaitTermination()
    got = {(r.facility_type, r.n, r.wins) for r in spark.read.parquet(target).collect()}
    assert got == {("a", 3, 2), ("c", 1, 1)}
    assert {f: os.path.getmtime(f"{target}/facility_type=c/{f}") for f in os.listdir(f"{target}/facility_type=c")} == untouched


@pytest.mark.parametrize("step", ["build", "write"])
def test_a_replayed_batch_reaches_the_former_facility(spark, tmp_path, monkeypatch, step):
    """Record 2 moves from a to b; the batch dies before or while the target is written."""
    silver, target = str(tmp_path / "silver"), str(tmp_path / "target")
    upserts.write_partitions(spark.createDataFrame([("a", 1, "win"), ("a", 2, "lose"), ("b", 3, "win")], SUBS), silver)
    upserts.write_partitions(_counts(spark.read.parquet(silver)), target)
    batch = spark.createDataFrame([("b", 2, "win", "upsert", 1)], CHANGE)
    failed = []

    def build(df):
        if step == "build" and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return _counts(df)

    write = refresh.write_partitions

    def broken(df, path):
        if step == "write" and path == target and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        write(df, path)

    monkeypatch.setattr(refresh, "write_partitions", broken)
    run = refresh.refresh_partitions(spark, silver, target, ["id"], build)
    with pytest.raises(RuntimeError):
        run(batch, 0)
    run(batch, 0)
    assert {(r.facility_type, r.n, r.wins) for r in spark.read.parquet(target).collect()} == {("a", 1, 1), ("b", 2, 2)}


def test_a_second_stream_keeps_every_row(spark, tmp_path):
    """Two checkpoints on one table, whose batch numbers both start at 0."""
    silver, target = (str(tmp_path / n) for n in ("silver", "target"))
    upserts.write_partitions(spark.createDataFrame([("a", 1, "win"), ("b", 2, "win"), ("b", 4, "win")], SUBS), silver)
    upserts.write_partitions(_counts(spark.read.parquet(silver)), target)
    for n, change in enumerate([("a", 1, "lose", "upsert", 1), ("b", 2, "lose", "upsert", 1)]):
        landing = str(tmp_path / f"landing{n}")
        spark.createDataFrame([change], CHANGE).write.parquet(landing)
        refresh.start_refresh(spark, landing, CHANGE, silver, target, str(tmp_path / f"ck{n}"), ["id"], _counts).awaitTermination()
    assert {(r.facility_type, r.id, r.result) for r in spark.read.parquet(silver).collect()} == {("a", 1, "lose"), ("b", 2, "lose"), ("b", 4, "win")}
    assert {(r.facility_type, r.n, r.wins) for r in spark.read.parquet(target).collect()} == {("a", 1, 0), ("b", 2, 1)}


def test_landing_validation(spark, tmp_path):
    from dossierlake import fixed

    schema = "doc_id string, " + ", ".join(f"{m} double" for m in fixed.MEASURES)
    landing, flags, ck = (str(tmp_path / n) for n in ("in", "flags", "ck"))
    row = ["d"] + [1000.0 if m == "site_area_sqm" else 1500.0 if m == "building_area_sqm" else None for m in fixed.MEASURES]
    spark.createDataFrame([tuple(row)], schema).write.parquet(landing)
    refresh.start_landing_validation(spark, landing, schema, flags, ck, ["doc_id"]).awaitTermination()
    assert [r.rule for r in spark.read.parquet(flags).collect()] == ["building_gt_site"]


def test_export(spark, tmp_path):
    root = str(tmp_path / "out")
    upserts.export_sheets({"area": spark.range(2), "scoring": spark.range(3)}, root, "csv")
    assert spark.read.option("header", "true").csv(f"{root}/scoring").count() == 3
