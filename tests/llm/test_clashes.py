"""Every operator and stage on tables whose extra columns bear the names that the code uses itself."""

import pytest

import corpus_pipeline
from residua.llm.licence_rules import licence_scan
from residua.llm.near_duplicates import near_duplicates
from residua.llm.packing import PackingConfig, pack_documents
from residua.llm.perplexity_filter import quality_verdicts
from residua.llm.piece_transducer import encode_documents
from residua.llm.quality_classifier import trusted_perplexity
from residua.llm.queries import tokenizer_path
from residua.llm.rendezvous import rendezvous_shards
from residua.llm.toxicity import fit_toxicity, score_toxicity

NAMES = "label fold _l _y _d _t _g _id _crc _size _text _lang _chunk _l0 _r0 _gone id n_shingles component_id kept score size shard slot good trusted key table doc piece length".split()


@pytest.fixture()
def clashing(spark, edge):
    return edge.select("doc_id", "text", "lang").selectExpr("*", *[f"'x' AS `{n}`" for n in NAMES])


def test_operators(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int").selectExpr("*", *[f"'y' AS `{n}`" for n in NAMES])
    model = fit_toxicity(clashing, labels)
    n = clashing.count()
    assert score_toxicity(clashing, model, ["doc_id"]).count() == n
    assert quality_verdicts(clashing, good=labels.where("quality = 1")).count() == n
    assert trusted_perplexity(clashing, labels.where("quality = 1")).count() == n
    assert near_duplicates(clashing).count() == n and licence_scan(clashing).count() == n and rendezvous_shards(clashing).count() == n
    assert encode_documents(clashing, tokenizer_path("piece_bpe_32k.model")).count() == n
    assert pack_documents(clashing, PackingConfig(tokenizer_path("word_bpe_49k.json"))).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


def test_stages_keep_clashing_columns(spark, clashing):
    sf = "/root/testdata/sf0.001"
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == clashing.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
