"""Registered queries against their SQL, and the pipeline against plain versions of its stages."""
import brute
import harness
import pytest

import corpus_pipeline
from rallygrid.llm.common import load
from rallygrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert harness.compare(QUERIES[name](spark, SF), con, ORACLES[name]) in (None, "no rows")


def test_personal_data_query(spark):
    import hashlib
    docs = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    rows = QUERIES["op8_disclosure_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute.spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_pipeline_stages(spark):
    docs = load(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality_rules"](spark, docs, SF).collect()
    kept = brute.quality([(i, r.text, r.source) for i, r in rows.items()])
    assert {r.doc_id for r in good} == {i for (i, _), k in kept.items() if k}
    table = spark.createDataFrame(good, docs.schema)
    one = steps["near_dedup"](spark, table, SF).collect()
    assert {r.doc_id for r in one} == {i for i, (_, c) in brute.near_dedup([(r.doc_id, r.text) for r in good]).items() if i == c}
    clean = steps["decontamination"](spark, spark.createDataFrame(one, docs.schema), SF).collect()
    hit = {d for d, _ in brute.contained([(r.doc_id, r.text) for r in one], items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in one} - hit
    table = spark.createDataFrame(clean, docs.schema)
    safe = steps["secret_scan"](spark, table, SF)
    assert safe.columns == docs.columns and safe.count() == len(clean)
    tokens = steps["byte_bpe"](spark, safe, SF).collect()
    assert {r.doc_id for r in tokens} == {r.doc_id for r in clean}
    assert corpus_pipeline.run(spark, SF).count() == len(clean)


def test_pipeline_of_an_empty_table(spark):
    docs = load(spark, SF, "documents")
    table = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
        assert table.count() == 0
        assert name == "byte_bpe" or table.columns == docs.columns
