"""Every query and stage on awkward and on empty tables."""

import os

import pytest

import corpus_pipeline
from vecfolio.llm import common
from vecfolio.llm.queries import QUERIES

CONTRACT = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op7_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op8_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_bpe_encoding": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op12_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13_structure_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}
PER_ROW = {n for n in QUERIES if n not in ("op7_nearest_neighbours", "op8_chat_formatting", "op12_prefix_trie", "op13_structure_repair")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nasty(spark, nasty, name):
    rows = QUERIES[name](spark, nasty)
    assert CONTRACT.get(name, set()) <= set(rows.columns)
    found = rows.collect()
    assert found
    if name in PER_ROW:
        assert len(found) == spark.read.parquet(f"{nasty}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    found = QUERIES[name](spark, empty).collect()
    assert len(found) == (1 if name == "op8_chat_formatting" else 0)


def test_pipeline_stages(spark, nasty, empty):
    for folder in (nasty, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.materialise(stage(spark, docs, folder))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        assert (docs.count() > 0) == (folder == nasty)
        assert not docs.filter("not round_trip").count()


def test_scratch_is_cleared(spark):
    path = common.scratch(spark)
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    root = path.rsplit("/", 1)[0].removeprefix("file:")
    assert spark.sparkContext.applicationId in root and os.path.isdir(root)
    common.clear_scratch(spark)
    assert not os.path.isdir(root)


def test_pipeline_leaves_its_last_input_only(spark, nasty):
    first = common.scratch(spark)
    root = first.rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = corpus_pipeline.run(spark, nasty)
    assert len(set(os.listdir(root)) - before) == 1 and rows.count()


def test_pipeline_keeps_and_drops(spark, nasty):
    docs = spark.read.parquet(f"{nasty}/documents.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, nasty).collect()
    kept = [r["doc_id"] for r in near]
    assert 5 in kept and 6 not in kept  # exact copies
    assert kept.count(8) == 1 and {9, 11, 13, 14, 17} <= set(kept)
    lines = {(r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, nasty).collect()}
    assert (10, "another") in lines and (9, [t for i, t in lines if i == 9][0]) in lines
    assert any(i == 12 and t.strip() == "y" for i, t in lines if t)
