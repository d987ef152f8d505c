
import corpus_pipeline
import pytest

import __spark_entry__ as entry
from agestrata.llm import mixing, secrets
from agestrata.llm.queries import QUERIES
from tests.llm.test_packing import _check
from tests.llm.test_simhash import _brute_classes, _brute_fp
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query(spark, con, name):
    verdict, rows, _, notes = compare(spark, con, name, SF)
    assert verdict in ("same", "rows only") and rows, notes


def test_registered():
    assert len(QUERIES) == 13 and {*QUERIES, "pipeline"} <= set(entry.queries())
    assert {k for k in entry.oracle_sql() if k in QUERIES} == {
        "op2_warc_round_trip", "op3_token_rollup", "op8_repeated_passages", "op9_source_mix",
        "op11_filter_audit", "op12_vector_codes", "op13_long_repeats",
    }


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    columns = docs.columns

    known = stages["language"](spark, docs, SF)
    assert known.columns == columns and known.count() == docs.count()
    kept = stages["near_duplicates"](spark, known, SF)
    rows = sorted(known.collect(), key=lambda r: r["doc_id"])
    classes = _brute_classes([_brute_fp(r["text"]) for r in rows], 2)
    first = {r["doc_id"] for i, r in enumerate(rows) if classes[i] == i}
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(first)

    clean = stages["secrets"](spark, kept, SF)
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == columns and before.keys() == after.keys()
    for i, text in before.items():
        spans = secrets.base_spans(text) + secrets.confirmed_spans(text)
        assert after[i] == secrets.redacted(text, spans, "[SECRET]") and (after[i] != text) == bool(spans)
        assert not secrets.base_spans(after[i])

    mixed = stages["mixing"](spark, clean, SF)
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(clean).collect() if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and counts == {k: v for k, v in times.items() if v}

    packed = stages["packing"](spark, mixed, SF).collect()
    _check(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()], 2048)
    assert len(packed) == corpus_pipeline.run(spark, SF).count()


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd.withColumn("lang", odd["lang"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_empty_input_passes_every_stage(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_rejected_documents_go(spark, documents):
    rows = [(i, "the cat sat on the mat and ran", "en", "s") for i in range(20)] + [(90, "12345 67", "en", "s"), (91, None, "en", "s"), (92, "--", None, "s")]
    out = corpus_pipeline.language_stage(spark, documents(rows), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))
