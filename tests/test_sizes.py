"""What only shows on larger tables: keys, amounts and plans beyond the small folders."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from dossierlake import session
from dossierlake.functions import text
from dossierlake.operators import conflicts, similar
from dossierlake.sources import search_index


def test_money_labels_of_large_keys(spark, tmp_path):
    """Amounts from a trillion on are told in 조 by the query and by its SQL, ties of the shown digit included."""
    keys = [1, 9999, 10000, 10500, 12500, 13500, 37500, 62500, 900000, 12345678]
    rows = [(3 * i, k, 1000.5 * k) for i, k in enumerate(keys)] + [(3 * i + 1, k, 7.0) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, contract.queries()["money_labels"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(contract.oracle_sql()["money_labels"]).fetchall())
    assert [label for key, label, _ in got if key % 3 == 0][:5] == ["1억", "9,999억", "1.0조", "1.1조", "1.2조"]


def _lines(n, words, seed):
    rnd = random.Random(seed)
    base = [[f"w{int(words * rnd.random() ** 2)}" for _ in range(rnd.randint(1, 30))] for _ in range(n)]
    near = [[w if rnd.random() < 0.9 else f"w{rnd.randrange(words)}" for w in rnd.choice(base)] for _ in range(n // 2)]
    return [(f"k{i % 2}", i, " ".join(t)) for i, t in enumerate(base + near)]


def _close(rows):
    """Pairs of different word sets of one key with a Jaccard index of 0.6 or more, by their smallest rows."""
    first = {}
    for key, i, text in rows:
        first.setdefault((key, frozenset(text.split())), i)
    return sorted(
        (k, min(i, j), max(i, j)) for ((k, s), i), ((m, t), j) in itertools.combinations(first.items(), 2) if k == m and 10 * len(s & t) >= 6 * len(s | t)
    )


@pytest.mark.parametrize("frequent", [20, similar.FREQUENT_LINKS])
def test_posts_of_frequent_words(spark, frequent):
    """Words that many lines hold cost one post each, not one for every pair of them, and lose no pair."""
    rows = _lines(500, 120, 5)
    df = spark.createDataFrame(rows, "doc string, idx int, description string")
    sets, linked = similar.duplicate_links(df, ["doc"], frequent=frequent)
    assert sorted(map(tuple, linked.select("doc", "a_id", "b_id").collect())) == _close(rows)
    if frequent == similar.FREQUENT_LINKS:
        named = sets.select(F.xxhash64("doc").alias("k"), "id", "tokens", F.size("tokens").alias("size"))
        assert similar._posts(named, 0.6, frequent).count() <= named.agg(F.sum(F.col("size") - F.ceil(F.col("size") * 0.6 - 1e-9) + 1)).first()[0]


def test_posts_carry_no_counters(spark):
    """The counters are broadcast, not a column that every row would copy; tokens and keys find theirs."""
    rows = [(i % 3 - 1, i, [f"w{i % 7}", f"v{i}"], 2) for i in range(60)]
    sets = spark.createDataFrame(rows, "k long, id long, tokens array<string>, size int")
    assert "AS _c" not in similar._posts(sets, 0.6, similar.FREQUENT_LINKS)._jdf.queryExecution().optimizedPlan().toString()
    for counters in (similar.COUNTERS, 2 * similar.COUNTERS):
        got = similar._counted(sets, counters).collect()
        assert len(got) == 60 and all(r.own == 20 and list(r.f) == [9 if r.id % 7 < 4 else 8, 1] for r in got)


@pytest.mark.parametrize("row_sets", [0, similar.ROW_SETS, 10_000])
def test_duplicate_sets_of_short_and_long_keys(spark, row_sets):
    """Keys settled in one row, by posts, and some this way and some that way give the same pairs."""
    rows = _lines(120, 60, 7) + [("short", 1, "a b c"), ("short", 2, "a b c d"), ("short", 3, "c b a"), (None, 1, "a b"), (None, 2, "a b c")]
    out = similar.duplicate_sets(spark.createDataFrame(rows, "doc string, idx int, description string"), ["doc"], row_sets=row_sets)
    across = out.where("a_id <> b_id").select("doc", "a_id", "b_id").collect()
    assert sorted(map(tuple, across)) == _close([r for r in rows if r[0]])
    assert [r.pairs for r in out.where("doc = 'short' AND a_id <> b_id").collect()] == [2]


def test_index_of_many_places_is_dealt_out(spark, tmp_path, monkeypatch):
    """A bucket is not one task's: more places make more tasks, and postings are those of plain Python."""
    monkeypatch.setattr(search_index, "PLACES_OF_TASK", 60)
    monkeypatch.setattr(search_index, "PLACES_AT_ONCE", 30)
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abA 가😀\n") for _ in range(rnd.choice([0, 1, 2, 3, 40])))
    docs = [(i, text() if i % 5 else None, text()) for i in range(60)]
    index = search_index.build_index(spark.createDataFrame(docs, "id long, a string, b string"), "id", ["a", "b"], str(tmp_path / "i"), buckets=2, splits=1)
    expected = {}
    for i, *columns in docs:
        for n, t in enumerate((c or "").lower() for c in columns):
            for p in range(len(t) - 2):
                expected.setdefault((t[p : p + 3], i), []).append((n << search_index.PLACE_BITS) + p)
    assert {(r.gram, r.key): list(r["at"]) for r in index.postings().collect()} == expected
    assert index.state["length"] == sum(map(len, expected.values())) == sum(r.len for r in index.documents().collect())
    assert len(list((tmp_path / "i/postings/generation=0/bucket=0").glob("*.parquet"))) > 5


def test_conflicts_without_their_values(spark):
    """Texts do not travel where only the flags are wanted; the losing rows are the same."""
    rows = [("d", "block", "b", n, f"{n}.pdf", None, "long text " * 50 + str(n // 2)) for n in range(5)]
    rows += [("d", "site", "s", n, f"2024010{n + 1}.pdf", 1.0 + n // 3, None) for n in range(5)]
    df = spark.createDataFrame(rows, "doc string, kind string, key string, file_no int, file_name string, number double, text string")
    shown, flags = conflicts.file_conflicts(df, ["doc"]), conflicts.file_conflicts(df, ["doc"], shown=False)
    assert sorted(map(tuple, shown.drop("chosen", "other").collect())) == sorted(map(tuple, flags.collect())) and flags.count() == 5
    assert {(r.chosen[-1], r.other[-1]) for r in shown.where("kind = 'block'").collect()} == {("0", "1"), ("0", "2")}
    assert [r.others for r in conflicts.conflict_flags(flags, ["doc"]).orderBy("kind").collect()] == [3, 2]


def test_partitions_are_bounded_by_size(spark):
    """Tuned sessions cut exchanges into many parts and join them up to a size, whatever the session's own number."""
    session.tune(spark)
    prefix = "spark.sql.adaptive."
    assert int(spark.conf.get(prefix + "coalescePartitions.initialPartitionNum")) > 3 and spark.conf.get(prefix + "advisoryPartitionSizeInBytes") == "16m"


def test_only_sets_of_candidates_are_asked_again(spark):
    """The words of a set are exchanged again only where a candidate pair names it."""
    sets = spark.range(20_000).selectExpr("id % 3 AS k", "id")
    wanted = similar._marked(sets.where("id % 50 = 0"))
    passed = {r.id for r in sets.where(similar._is_marked(wanted, "k", "id")).collect()}
    assert {i for i in range(20_000) if i % 50 == 0} <= passed
    assert len(passed) < 500


def test_word_sets_that_differ_by_a_sign_stay_apart(spark):
    rows = [("d", 1, "a b\tc"), ("d", 2, "c  b a"), ("d", 3, "a b c ab"), ("d", 4, "a,b c"), ("d", 5, " ")]
    sets, _ = similar.duplicate_links(spark.createDataFrame(rows, "doc string, idx int, description string"), ["doc"])
    assert sorted((r.id, r.members, tuple(r.tokens)) for r in sets.collect()) == [
        (1, 2, ("a", "b", "c")), (3, 1, ("a", "ab", "b", "c")), (4, 1, ("a,b", "c")),
    ]


def test_floor_matrix_makes_its_cells_once(spark):
    """The cells that name the columns are the ones that the pivot reads, not a second computation."""
    from dossierlake.operators import comparison

    rows = [("k", 1, 1, "B2", "office"), ("k", 2, 2, "3F", "office"), ("k", 2, 3, "0F", "office"), ("k", 3, 4, "?", "office"), ("k", 1, 5, "옥상", "office")]
    plans = spark.createDataFrame(rows, "key string, company int, ord int, floor_level string, programme string")
    out = comparison.floor_matrix(comparison.floor_cells(plans, ["key"]), ["key"])
    assert out.inputFiles()
    assert out.columns == ["key", "floor_order", "floor", "1", "2"]
    assert sorted((r.floor, r["1"] is None, r["2"] is None) for r in out.collect()) == [("3F", True, False), ("B2", False, True), ("ROOF", False, True)]


def test_plain_numbers(spark):
    texts = ["1,440", "30.0", "18.30", "007", "0", "00", "0.50", "7", "1,0.0", "100", "1.", "", "0,01", "12.005", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.plain_number("t")).collect()]
    assert got == ["1440", "30", "18.3", "7", "0", "0", "0.5", "7", "10", "100", "1", "", "1", "12.005", None]


def test_numbers_are_claimed_once(spark):
    """A number that a text repeats is one row, and what is claimed is exchanged once, for the join with the sources."""
    from dossierlake.operators import prose

    claims = spark.createDataFrame([("d", "f", "15세대, 15세대 15 세대 그리고 15 또 15 1,500만원 7 5% 007호"), ("d", "g", "15 20.0")], "doc string, field string, text string")
    sources = spark.createDataFrame([("d", "20 15 5 %"), ("e", "1,500만원")], "doc string, text string")
    assert prose.prose_numbers(claims, ["doc", "field"]).count() == 8
    out = prose.ungrounded_numbers(claims, sources, ["doc"])
    assert sorted(map(tuple, out.select("field", "norm", "unit").collect())) == [("f", "15", "세대"), ("f", "1500", "만원"), ("f", "7", "호")]
