"""The pipeline, stage by stage, against plain Python on the same input."""

import re

import public_tokenizers
import pytest
from llm_helpers import FOLDER
from test_exact_operators import brute_contamination, brute_links

import corpus_pipeline
from dossierlake.llm import common, packing, private_data, toxicity


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], FOLDER), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert all(rows(s).keys() <= rows(stages[0]).keys() for s in stages[1:])


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    before = stages[0].collect()
    scores = [s for _, s in toxicity._scored(((r.text,) for r in before), model)]
    assert sorted(r.doc_id for r, s in zip(before, scores) if s < 0.5) == sorted(rows(stages[1]))


def test_one_of_every_group_stays(stages):
    linked = brute_links([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert sorted({component for _, _, component, _ in linked}) == sorted(rows(stages[2]))


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in stages[2].collect() if not brute_contamination(r.text, items)[1]]
    assert sorted(clean) == sorted(rows(stages[3]))


def test_private_data_is_masked(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        base = private_data.base_spans(before[i].text)
        assert (r.text == before[i].text) == (not base) and r.n_chars == len(r.text)
        for k, s, e in base:
            assert before[i].text[s:e] not in r.text
            assert re.search(f"<{private_data.KINDS[k].upper()}>", r.text) or len(base) > 1


def test_all_that_is_left_is_packed(spark, stages):
    expected = packing.token_pieces(stages[4], public_tokenizers.path("word_bpe_49k.json")).collect()
    got = stages[5].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_run(spark, stages):
    final = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, final.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, stages[5].select("doc_id", "piece", "length", "ids_crc32").collect())
    )
