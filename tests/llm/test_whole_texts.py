"""What former cuts and switches by size left out: the same result on either side of each."""

import numpy as np
import pyarrow as pa
from llm_helpers import prose
from dossierlake.llm import page_text, private_data, quality, toxicity, url_rules
from dossierlake.llm.common import alnum_words


def test_long_runs_of_digits():
    zeros, nines = "0" * 5000, "9" * 5000
    ips = lambda text: [s for s in private_data.base_spans(text) if s[0] == 1]
    assert ips(zeros + "1.2.3.4") == [(1, 0, 5007)]
    assert ips(f"1.{zeros}7.{zeros}.256.1") == [] and ips(f"1.{zeros}7.{zeros}.255.1") == [(1, 0, 10_008)]
    assert ips(nines + ".1.1.1") == [] and ips("0.0.0.0") == [(1, 0, 7)]


def test_whole_tokens_and_words_count():
    long = "ab1-" * 30
    a, b = private_data.document_graph("word " + long + "X"), private_data.document_graph("word " + long + "9")
    assert a.feature.tolist() != b.feature.tolist()
    before = "w" * 30
    a, b = private_data.document_graph(before + "x 1"), private_data.document_graph(before + "y 1")
    assert a.feature.tolist() != b.feature.tolist()


def texts_of(page):
    return [t for _, t, _ in page_text.blocks(page)]


def test_foreign_and_custom_elements():
    assert texts_of('<p>A</p><svg class="x"/><p>B</p>') == ["A", "B"]
    assert texts_of("<p>A</p><svg><text>no</text></svg><p>B</p>") == ["A", "B"]
    assert texts_of("<p>A<svg><p>B</p>") == ["A", "B"]
    assert texts_of("<p>A</p><template-card><p>C</p></template-card><p>B</p>") == ["A", "C", "B"]
    assert texts_of("<template><p>no</p></template><scripted>B</scripted>") == ["B"]
    assert texts_of("<p>A</p><script>no <p>no") == ["A"] and texts_of("<style/>no") == []
    assert texts_of("<svg>" * 20_000 + "end") == ["end"]


def test_pages_without_named_parts(spark):
    plain = "<html><body><p>First words here.</p><nav><a href=x>Menu</a></nav><p><a href=y>link</a></p><p>Second words.</p></body></html>"
    model = page_text.fit([plain] * 3)
    assert not model.trained and page_text.main_texts(model, [plain, "", None]) == ["First words here.\nSecond words.", "", ""]


def test_toxicity_in_pieces(monkeypatch):
    model = toxicity.fit([(prose(i, 20) + (" wretch" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)])
    texts = [prose(5, 3000) + " wretch", "", prose(6, 10), "é" * 700]
    places = [toxicity.text_places(t) for t in texts]
    assert all(np.array_equal(p, toxicity.word_places(alnum_words(t))) for p, t in zip(places, texts))
    assert all(np.array_equal(p, toxicity.text_places(t, 100)) for p, t in zip(places, texts))
    whole = model.logits(places)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.allclose(whole, model.logits(places), atol=1e-5)


def test_quality_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [prose(7, 700), "  lead " + "same " * 300, "x" * 3000 + " " + prose(8, 200), " \n", "é\t" * 500, "".join(rng.choice(list("ab  \n.É"), 5000))]
    whole = [quality.passages(t) for t in texts]
    for size in (37, 500, 4000):
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        assert all(np.allclose(w, quality.passages(t), atol=1e-6) for w, t in zip(whole, texts))


def test_rules_keep_their_order_in_any_number(spark, monkeypatch):
    rules = [("block", "b.example.org", "/x"), ("allow", "a.example.org", "/x"), ("allow", "example.org", "/" + "y" * 5000), ("block", "example.org", "/")]
    pages = spark.createDataFrame(
        [(1, "http://b.example.org/x"), (2, "http://a.example.org/x"), (3, "http://example.org/" + "y" * 5001), (4, "http://example.org/" + "-".join(map(str, range(3000)))), (5, None)],
        "page_id long, url string",
    )
    results = []
    for bound in (50_000, 1):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
        got = url_rules.judge_urls(pages, url_rules.path_rules(spark, rules).unionByName(url_rules.word_rules(spark)))
        results.append(sorted((r.page_id, r.rule, r.verdict) for r in got.collect()))
    assert results[0] == results[1]
    assert [v for _, _, v in results[0]] == ["block", "allow", "allow", "block", "allow"]


def test_equal_length_rules_go_by_name(spark, monkeypatch):
    from pyspark.sql import functions as F

    for bound in (50_000, 1):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
        rules = url_rules.path_rules(spark, [("allow", "org", "/ab"), ("block", "org", "/ab")])
        same = rules.withColumn("rule", F.when(F.col("verdict") == "allow", F.lit("n1")).otherwise(F.lit("n")))
        got = url_rules.judge_urls(spark.createDataFrame([(1, "http://x.org/abc")], "page_id long, url string"), same)
        assert [(r.rule, r.verdict) for r in got.collect()] == [("n", "block")]




def test_batches_of_long_rows_are_bounded(spark):
    """A worker's batch follows the bytes of its rows, not their number alone."""
    from dossierlake.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]}, schema=pa.schema([("bytes", pa.int64()), ("rows", pa.int64())]))

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) AS text")
    got = common.bounded(rows).mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in got) == 3000
    assert max(r.bytes for r in got) < 2 * common.BATCH_BYTES
    out = list(common.arrow_batches(((i, "x" * 1_000_000) for i in range(20)), pa.schema([("i", pa.int64()), ("t", pa.string())])))
    assert sum(b.num_rows for b in out) == 20 and max(b.nbytes for b in out) < 2 * common.BATCH_BYTES
