"""Cases that once crashed or lost columns."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tallyspark.llm import mixing, sharding, simhash, toxicity
from tallyspark.llm.common import spare, without


@pytest.mark.parametrize("texts", [[None, "", " \n"], [" ", "word", " ", "word"], ["word", " ", "word", ""]])
def test_training_texts_without_words(spark, texts):
    docs = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(40)] + [(90, "some words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    rate = toxicity.training_labels(labels, "doc_id", "toxic").agg({"y": "avg"}).first()[0]
    scores = {r["id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(scores) == 41 and all(0 <= s <= 1 for s in scores.values())
    blank = next(k for k, t in enumerate(texts) if not (t or "").split())
    assert scores[blank] == pytest.approx(rate) and scores[90] == pytest.approx(0.5, abs=0.2)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_drained_shards_get_nothing(spark):
    tree = sharding.Tree((((1.0, 0.0), (2.0,)), ((0.0, 0.0), (0.0,)), ((0.0, 0.0, 3.0),)))
    docs = spark.range(3000).selectExpr("id as doc_id", "'x' as text")
    rows = sharding.assign_shards(docs, tree=tree).collect()
    n = Counter(r["shard"] for r in rows)
    assert set(n) == {0, 2, 8} and n[8] > n[2] > n[0] > 300
    assert {r["grown_shard"] for r in rows} == {0, 2, 8, 9} and all(r["grown_shard"] in (r["shard"], 9) for r in rows)
    full = sharding.Tree((((1.0, 1.0), (2.0,)), ((0.0, 0.0), (0.0,)), ((0.0, 0.0, 3.0),)))
    before = {r["id"]: r["shard"] for r in sharding.assign_shards(docs, tree=full).collect()}
    moved = {(before[r["id"]], r["shard"]) for r in rows if before[r["id"]] != r["shard"]}
    assert moved <= {(1, 0), (1, 2), (0, 2), (0, 8), (1, 8), (2, 8)}  # a drained shard's rows, and those of a subtree whose weight fell
    for bad in ((((0.0,),),), (((-1.0, 2.0),),)):
        with pytest.raises(ValueError, match="weights"):
            sharding.Tree(bad)


def test_stages_return_the_columns_of_documents(spark, odd_docs):
    rows = Counter(map(tuple, odd_docs.collect()))
    for got in (mixing.mixed_documents(odd_docs), simhash.keep_one_of_each(odd_docs), without(odd_docs, "doc_id", odd_docs.where("doc_id > 20"), "doc_id")):
        assert got.columns == odd_docs.columns
        assert set(map(tuple, got.collect())) <= set(rows)
    labels = spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][3] == "source_mixing"


def test_spare_names(spark):
    assert spare(spark.createDataFrame([(1, 2)], "__Hash int, __hash_ int"), "hash", "chunk") == ["__hash__", "__chunk"]
