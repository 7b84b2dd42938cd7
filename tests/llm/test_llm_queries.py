"""The named queries and the pipeline on the small tables."""

import zlib

import pytest

import corpus_pipeline
from compare import compare, connect
from paymend.llm import decontaminate, jaccard_join, quality_classifier, quality_rules
from paymend.llm.queries import ORACLES, QUERIES

ROWS = {"op4_url_filter": "pages", "op6_html_extraction": "pages", "op7_warc": "pages"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_decontamination", "op5_best_fit_packing", "op12_conversation_trie", "op13_conversation_repair"}))
def test_a_row_for_every_row(spark, folder, name):
    table = spark.read.parquet(f"{folder}/{ROWS.get(name, 'documents')}.parquet")
    assert QUERIES[name](spark, folder).count() == table.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    ok, message = compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name])
    assert ok, message


def test_names_cover_all():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_decide_as_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    left = docs
    want = [
        lambda d: {r.doc_id for r in quality_rules.quality_report(d).where("kept").collect()},
        lambda d: {r.doc_id for r in quality_classifier.quality_scores(d, labels).where("predicted = 1").collect()},
        lambda d: {r.doc_id for r in jaccard_join.jaccard_components(d, 5, 80).where("doc_id = component_id").collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.contaminated(d, items).collect()},
    ]
    for (_, stage), expected in zip(corpus_pipeline.STAGES, want):
        after = stage(spark, left, folder).cache()
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} == expected(left)
        left = after
    rows = corpus_pipeline.STAGES[4][1](spark, left, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in left.collect()}
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_pipeline_stages_on_messy_rows(spark, messy, folder):
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, messy, folder)
        assert after.columns == messy.columns and after.count() <= messy.count()
    near = corpus_pipeline.near_duplicates(spark, messy, folder).collect()
    ids = [r.doc_id for r in near if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and not {6, 7} & set(ids) and 5 in ids
    assert zlib.crc32(b"") == 0
