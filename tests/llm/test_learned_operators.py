"""Learned operators: held-out accuracy, edge cases, and what must hold whatever was learned."""

import re
import zlib

import numpy as np
import pytest
from llm_helpers import EDGE, edge_docs, empty_docs, prose

from dossierlake.llm import page_text, private_data, quality, toxicity, training
from dossierlake.llm.common import alnum_words
from dossierlake.llm.queries import op6_toxicity, op7_private_data, op9_quality

SF = "/root/testdata/sf0.01"


def test_sample_leaves_the_held_out_fold_alone(spark):
    docs = edge_docs(spark, [(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = training.labelled_sample(docs, labels, "toxic", 30, 1000)
    ids = [int(t.split()[1]) for t, _ in got]
    assert 50 <= len(got) <= 60 and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and all(y == i % 2 for i, (_, y) in zip(ids, got))
    assert got == training.labelled_sample(docs.repartition(7), labels, "toxic", 30, 1000)


@pytest.fixture(scope="module")
def toxic_model():
    texts = [prose(i, 30) + (" you wretch " if i % 4 == 0 else " ") + prose(1000 + i, 10) for i in range(600)]
    return toxicity.fit([(t, int(i % 4 == 0)) for i, t in enumerate(texts)])


def test_toxicity_learns_a_word(spark, toxic_model):
    fresh = [(i, prose(5000 + i, 200) + (" Wretch!" if i % 2 else "")) for i in range(200)]
    got = {r.doc_id: r.score for r in toxicity.score_documents(edge_docs(spark, fresh), toxic_model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i, _ in fresh)
    kept = toxicity.drop_toxic(edge_docs(spark, fresh), toxic_model)
    assert kept.columns == edge_docs(spark).columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 200, 2))


def test_toxicity_edges(spark, toxic_model):
    got = toxicity.score_documents(edge_docs(spark), toxic_model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id): r.score for r in got}
    assert by[1] == by[2] == by[3]
    assert toxicity.score_documents(empty_docs(spark), toxic_model).count() == 0
    assert toxicity.fit([]).logits([np.zeros((0, 3), np.int64)])[0] == 0


def test_long_texts_are_convolved_piece_by_piece(toxic_model, monkeypatch):
    places = toxicity.word_places(alnum_words(prose(1, 997) + " wretch"))
    whole = toxic_model.logits([places])
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.allclose(whole, toxic_model.logits([places, places])[1], atol=1e-5)


def test_quality_edges(spark):
    model = quality.fit([(prose(i, 150), 1) for i in range(100)] + [("JUNK!! " * 80, 0) for _ in range(100)])
    fresh = [(i, prose(900 + i, 400) if i % 2 else "TRASH!! SOLD!! " * 60) for i in range(40)]
    got = {r.doc_id: r.score for r in quality.score_documents(edge_docs(spark, fresh), model).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i, _ in fresh)
    edge = quality.score_documents(edge_docs(spark), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert quality.score_documents(empty_docs(spark), model).count() == 0
    assert quality.fit([]).scores([quality.passages("")])[0] == 0.5


def test_attention_gradients():
    """The gradients of the quality model against differences."""
    model = quality.fit([])
    rng = np.random.default_rng(0)
    model.weights = [rng.normal(0, 0.3, w.shape) for w in model.weights]
    bags, y = [rng.random((k, quality.FEATURES)) for k in (1, 3, 2)], np.array([1.0, 0, 1])

    def loss():
        p = model.scores(bags)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(model.weights, quality._gradients(model, bags, y)):
        at = tuple(rng.integers(s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_queries_reach_accuracy_on_the_held_out_fold(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in op9_quality(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in held]) >= 0.95
    toxic = [r for r in op6_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    # under 50 examples of label 1 here, some of them without any sign of it
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in toxic]) >= 0.85


# personal data


def brute_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in email.finditer(text)]
    out += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in card.finditer(text):
        d = [int(c) for c in digits(m)]
        doubled = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])]
        if 13 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = np.random.default_rng(4)
    parts = ["a@b.c", "x.y+z@host-1.example.com", "@", "a@", "1.2.3.4", "300.1.1.1.1.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (499) 555-6503", "+", "-", ".", " ", "é", "12", "0007.1.2.3"]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 9)))
        assert private_data.base_spans(text) == brute_spans(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 200_000):
        private_data.base_spans(text)  # in linear time


def test_links_carry_labels(spark):
    model = private_data.fit([f"call +1 (499) 555-{i:04d} or {i} times, mail u{i}@mail.example.com on 12.5." for i in range(1000, 1400)])
    rows = [(1, "Call +1 (499) 555-6503 now, 555-6503 at night, room 555."), (2, "555-6503 alone, 12 and 2024"), (3, None), (4, "a@b.c A@B.C " * 3000)]
    got = {r.doc_id: r for r in private_data.find_private_data(edge_docs(spark, rows), model).collect()}
    text = rows[0][1]
    assert got[1].base == [3, *re.search(r"\+1.*6503(?= now)", text).span()]
    assert got[1].added == [3, *re.search(r"555-6503(?= at)", text).span()]
    assert got[2].base == got[2].added == got[3].base == got[3].added == []
    assert len(got[4].base) == 18_000
    masked = {r.doc_id: r for r in private_data.mask_private_data(edge_docs(spark, rows), model).collect()}
    assert masked[1].text == "Call <PHONE> now, <PHONE> at night, room 555." and masked[1].n_chars == len(masked[1].text)
    assert masked[2].text == rows[1][1] and masked[2].n_chars == 7 and masked[3].text is None
    assert private_data.find_private_data(empty_docs(spark), model).count() == 0
    assert private_data.fit([]).skip[1, 1] > 0


def test_links_carry_labels_at_any_distance():
    """A match ties all later repeats of its token, near or far, and messages settle by document."""
    model = private_data.fit([f"call +1 (499) 555-{i:04d} or {i} times, mail u{i}@mail.example.com on 12.5." for i in range(1000, 1400)])
    far = "+1 (499) 555-6503 " + prose(1, 40) + " 5556503 then" * 80
    mirrored = "5556503 then " * 80 + prose(1, 40) + " +1 (499) 555-6503"
    texts = [far, mirrored, "1 2 3 4 5 6 7 8 9 " * 300 + "a@b.c"]
    bases = [private_data.base_spans(t) for t in texts]
    together = private_data.added_spans(model, texts, bases)
    for text, spans in zip(texts[:2], together):
        assert [(3, *m.span()) for m in re.finditer("5556503", text)] == spans
    assert together == [private_data.added_spans(model, [t], [b])[0] for t, b in zip(texts, bases)]


def test_field_finds_what_no_pattern_of_the_document_ties(spark):
    """What was learned adds a span in a document without any match, if it is sure enough."""
    model = private_data.fit([f"call +1 (499) 555-{i:04d} or {i} times, mail u{i}@mail.example.com on 12.5." for i in range(1000, 1400)])
    rows = [(1, "please call 1 (499) 555-6503 today"), (2, "we met 12 and 2024 times"), (3, "call 1 (499) 555-6503 or mail a@b.c")]
    got = {r.doc_id: r for r in private_data.find_private_data(edge_docs(spark, rows), model).collect()}
    for i, text in (rows[0], rows[2]):
        assert got[i].added == [3, *re.search(r"1 \(.*6503", text).span()]
    assert got[1].base == got[2].base == got[2].added == []
    masked = {r.doc_id: r.text for r in private_data.mask_private_data(edge_docs(spark, rows), model).collect()}
    assert masked[1] == "please call <PHONE> today" and masked[2] == rows[1][1] and masked[3] == "call <PHONE> or mail <EMAIL>"


def test_needed_probability_is_calibrated():
    p = np.array([[1 - q, q, 0, 0, 0] for q in (0.99, 0.98, 0.97, 0.96, 0.95, 0.2)])
    assert private_data._least_sure(p, np.array([1, 1, 1, 1, 1, 1])) == private_data.SURE
    assert private_data._least_sure(p, np.array([1, 1, 1, 0, 0, 0])) == 0.97
    assert private_data._least_sure(p, np.array([0, 0, 0, 0, 0, 0])) > 1


def test_private_data_query(spark):
    import hashlib

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op7_private_data(spark, SF).collect():
        base = brute_spans(text[r.doc_id])
        listed = [f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | (set() if listed else {""})


# page text

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    "<!-- ad --><div class=\"ad\">Buy now</div><article><h1>Head &amp; tail</h1><p><b>First  line of\n text.<br><p>Second &lt;one&gt; {n} &eacute;.</p></article>"
    "<footer>&copy; site</footer></body></html>"
)


def test_page_text(spark):
    model = page_text.fit([PAGE.replace("{n}", prose(i, 12)) for i in range(120)])
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE[:-40]), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", PAGE.replace("{n}", "word " * 50_000)),
            (6, "u", PAGE.replace("article", "main").replace('"ad"', '"cookie-notice"'))]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = page_text.extract_main_text(pages, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[None] == by[6] == "Head & tail\nFirst line of text.\nSecond <one> {n} é."
    assert by[2] == by[3] == by[4] == ""
    assert by[5].count("word") == 50_000
    assert page_text.extract_main_text(pages.limit(0), model).count() == 0


def test_labeller_reads_whole_blocks():
    """Words anywhere in a block count for its vector, and a tail alone can tell two blocks apart."""
    head = prose(1, 200)
    page = "<div><div>{}</div></div>"
    model = page_text.BlockLabeller(1)
    one, two = (model.inputs([page_text.describe(page_text.blocks(page.format(f"{head} {tail}")))])[0] for tail in ("alpha", "gamma"))
    assert one.shape == two.shape and not np.allclose(one, two)
    text = "Ab-c " * 30_000 + prose(2, 5000)
    found = page_text.describe(page_text.blocks(f"<p>{text}</p>"))
    words = alnum_words(" ".join(text.split()))
    expected = np.bincount([zlib.crc32(w) % page_text.WORD_PLACES for w in words], minlength=page_text.WORD_PLACES)
    assert np.array_equal(np.bincount(found.word, found.count, page_text.WORD_PLACES), expected)


def test_labeller_gradients():
    """The gradients of the recurrent network against differences."""
    pages = [page_text.describe(page_text.blocks(PAGE)), page_text.describe(page_text.blocks(PAGE)[:3])]
    labels = [np.array([0, 0, 0, 1, 1, 1, 0][: p.n], float) for p in pages]
    model = page_text.BlockLabeller(1)
    model.path, model.word = model.path.astype(float), model.word.astype(float)
    model.cells, model.out = [[w.astype(float) for w in c] for c in model.cells], [w.astype(float) for w in model.out]

    def loss():
        z = np.concatenate(model.logits(pages)).astype(float)
        y = np.concatenate(labels)
        return np.mean(np.logaddexp(0, z) - y * z)

    rng = np.random.default_rng(0)
    for k, (w, g) in enumerate(zip(model.parameters(), model.gradients(pages, labels))):
        at = np.unravel_index(np.abs(g).argmax(), g.shape) if k < 2 else tuple(rng.integers(s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_lowest_hashed_is_the_same_however_the_rows_lie(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).withColumnRenamed("id", "key")
    expected = [r.key for r in rows.orderBy(F.xxhash64("key"), "key").limit(300).collect()]
    assert [r.key for r in training.lowest_hashed(rows.repartition(17), "key", 300).collect()] == expected
    assert training.lowest_hashed(rows.limit(10), "key", 300).count() == 10
