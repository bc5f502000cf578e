"""The whole pipeline, and the scorer that it begins with, against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyspark.llm import sharding, toxicity

from .test_native import plain_mix, plain_shard
from .test_near_copies import kept_by_all_pairs
from .test_python_stages import plain_contained

SF = "/root/testdata/sf0.001"


def plain_score(model: toxicity.Model, text: str | None) -> float:
    """The highest bag of four words, one word's features at a time."""
    words, best = (text or "").encode().lower().split(), None
    for at in range(0, len(words), 4):
        total = count = 0
        for w in words[at : at + 4]:
            rows, n = toxicity.word_features([w])
            total += float(np.float64(model.weight[rows]).sum())
            count += int(n[0])
        z = total / count + model.bias
        best = z if best is None else max(best, z)
    return model.base if best is None else 1 / (1 + math.exp(-min(30.0, max(-30.0, best))))


def test_scores(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_model(sf_docs, labels)
    rows = sf_docs.select("doc_id", "text").collect()
    got = {r["id"]: r["score"] for r in toxicity.toxicity_scores(sf_docs, labels).collect()}
    assert got == pytest.approx({r[0]: plain_score(model, r[1]) for r in rows}, abs=1e-6)


def test_pipeline(spark, sf_docs):
    model = toxicity.fit_model(sf_docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in sf_docs.select("doc_id", "source", "text").collect()]
    texts = {i: t for i, _, t in rows}
    clean = [r for r in rows if plain_score(model, r[2]) < 0.5]
    one_of_each = kept_by_all_pairs([(i, t or "") for i, _, t in clean])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, *_ in plain_contained([(i, t) for i, _, t in clean if i in one_of_each], items)}
    left = [r for r in clean if r[0] in one_of_each - leaked]
    want = Counter((i, plain_shard(i, sharding.DEFAULT), len((texts[i] or "").encode()) + 16) for i, _ in plain_mix(left))
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == [*sf_docs.columns, "shard", "size"]
    assert Counter((r["doc_id"], r["shard"], r["size"]) for r in found.collect()) == want and len(left) < len(clean) < len(rows)
