"""The stored index: scores as by scanning, refresh as by rebuilding, replays and compaction."""

import re

import pytest
from pyspark.sql import functions as F
from test_search_sources import DOCS, WEIGHTS, _bm25

from dossierlake.operators import search
from dossierlake.sources import search_index

DDL = "id string, title string, body string"
CHANGES = "id string, op string, seq long, title string, body string"
FIRST = [("1", "upsert", 1, "aaaa stadium", "changed stadium"), ("2", "delete", 2, None, None), ("9", "upsert", 3, None, "stadium stadium")]
SECOND = [
    ("9", "delete", 1, None, None), ("9", "upsert", 2, "park aaa", ""), ("3", "upsert", 4, "x", "y"), ("3", "delete", 5, None, None),
    ("8", "delete", 1, None, None),
]
AFTER = [("1", "aaaa stadium", "changed stadium"), ("4", "AAA", ""), ("5", "other text", "more"), ("9", "park aaa", "")]


@pytest.fixture
def index(spark, tmp_path):
    return search_index.build_index(spark.createDataFrame(DOCS, DDL), "id", ["title", "body"], str(tmp_path / "index"), buckets=4, splits=2)


def contents(index):
    postings = sorted((r.gram, r.key, r.len, tuple(r["at"])) for r in index.postings().collect())
    return postings, sorted(map(tuple, index.documents().collect())), index.state["docs"], index.state["length"]


def changed(spark, index, rows, batch, source="s"):
    return search_index.apply_batch(spark, index.path, spark.createDataFrame(rows, CHANGES), source, batch)


def test_scores(spark, index):
    for phrases in (["aaa"], ["stadium"], ["aaa", "stadium", "ab"], ["ium sta", "ther t"]):
        got = {r.id: r.score for r in search_index.bm25(index, phrases, WEIGHTS).collect()}
        expected = _bm25([p for p in phrases if len(p) >= 3])
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert search_index.bm25(index, ["aa"], WEIGHTS).isEmpty()
    assert [r.id for r in search_index.search(index, ["stadium"], WEIGHTS, limit=1).collect()] == ["1"]
    docs = spark.createDataFrame(DOCS, DDL)
    for phrase in ("Stadium", "aaa", "aaaaa", "dium st", "nowhere"):
        hits = {r.id for r in search_index.phrase_matches(index, phrase).collect()}
        assert hits == {r.id for r in search.phrase_matches(docs, phrase, ["title", "body"]).collect()}
    assert {r.id for r in search_index.phrase_matches(index, "stadium", ["title"]).collect()} == {"1"}


def test_only_the_needed_buckets_are_read(index):
    plan = search_index.bm25(index, ["stadium"], WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "PushedFilters: [In(gram" in plan


def test_refresh_equals_rebuild(spark, index, tmp_path):
    for rows, batch in ((FIRST, 0), (FIRST, 0), (SECOND, 1), (FIRST, 0)):  # delivered twice, and late
        now = changed(spark, index, rows, batch)
    again = search_index.build_index(spark.createDataFrame(AFTER, DDL), "id", ["title", "body"], str(tmp_path / "again"), buckets=4)
    assert contents(now) == contents(again)
    packed = search_index.compact(spark, index.path)
    assert contents(packed) == contents(again)
    search_index.vacuum(spark, index.path)
    assert contents(search_index.Index(spark, index.path)) == contents(again)
    assert contents(changed(spark, index, FIRST, 0)) == contents(again)  # still known after compaction
    other = changed(spark, index, [("7", "upsert", 1, "new", "row")], 0, source="another")
    assert other.state["docs"] == 5


def test_a_batch_that_failed_is_written_anew(spark, index, tmp_path, monkeypatch):
    before = contents(index)
    monkeypatch.setattr(search_index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        changed(spark, index, FIRST, 0)
    assert contents(search_index.Index(spark, index.path)) == before
    monkeypatch.undo()
    now = changed(spark, index, FIRST, 0)
    assert now.state["docs"] == 5 and {r.id for r in search_index.phrase_matches(now, "stadium").collect()} == {"1", "9"}


def test_words(spark, tmp_path):
    docs = spark.createDataFrame([("1", "the end of the end"), ("2", "THE-END"), ("3", "other end"), ("4", None)], "id string, t string")
    index = search_index.build_index(docs, "id", ["t"], str(tmp_path / "words"), tokens="word")
    found, _ = search_index.phrase_frequencies(index, ["the end", "he"])
    assert {r.key: r.f0 for r in found.where(F.col("f0") > 0).collect()} == {"1": 2.0, "2": 1.0}
    assert found.where(F.col("f1") > 0).isEmpty() and index.state["docs"] == 4 and index.state["length"] == 9


def test_stream(spark, index, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "ck")
    for rows in (FIRST, SECOND):
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(landing)
        search_index.start_index_refresh(spark, landing, CHANGES, index.path, checkpoint).awaitTermination()
    assert sorted(r.key for r in search_index.Index(spark, index.path).documents().collect()) == [i for i, *_ in AFTER]
